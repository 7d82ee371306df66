"""Mix sources to target shares of the total size, repeating no record more often than a cap.

For each mix the total is the largest that no source's cap forbids: min over sources of cap * tokens / share. Every
record of a source then has the same expected number of copies; its whole part is taken outright and its fraction is
decided by pivotal dependent rounding: two fractions meet, mass moves at random from one to the other until one is
integral, the other goes on to meet the next. Records meet from the largest to the smallest, so that little size moves with the mass
and the size drawn stays near its expectation; one rounding decides, so every record keeps the probability that is set.
Each shard leaves one undecided record; these residuals meet in turn in a reduction tree of bounded fan-in.

Defined results: records of no known source, of no tokens, or of sources a mix does not name are not drawn; a named
source without tokens cannot contribute and is reported with share 0, and the rest keep their proportions; a mix none
of whose sources has tokens draws nothing; repeated ids are records of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import cut, spread

EPS = 1e-9


def pivotal(probabilities: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """(0/1 decisions, index of the undecided record or -1, its probability): sequential pivotal rounding."""
    out = np.zeros(len(probabilities), dtype=np.int64)
    i, p = -1, 0.0
    draws = rng.random(len(probabilities))
    for j, q in enumerate(probabilities):
        if i < 0:
            i, p = j, q
        elif p + q <= 1.0 + EPS:
            if draws[j] * (p + q) >= p:  # j takes the mass of both
                i = j
            p = p + q
        else:
            if draws[j] * (2.0 - p - q) < 1.0 - q:  # i becomes 1, j goes on with the rest
                out[i] = 1
                i = j
            else:
                out[j] = 1
            p = p + q - 1.0
        if p >= 1.0 - EPS:
            out[i], i, p = 1, -1, 0.0
        elif p <= EPS:
            i, p = -1, 0.0
    return out, i, p


def _expected(records: DataFrame, targets: DataFrame) -> DataFrame:
    sizes = records.groupBy("source").agg(F.sum("n_tokens").alias("_size"), F.count("*").alias("_count"))
    plan = targets.join(sizes, "source", "left").filter("_size > 0 and target_share > 0 and max_repeats > 0")
    total = F.min(F.col("max_repeats") * F.col("_size") / F.col("target_share")).over(Window.partitionBy("mix_id"))
    return plan.withColumn("_copies", F.col("target_share") * total / F.col("_size"))


def mix_sources(
    records: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 17, shard_records: int = 8192, fan_in: int = 32
) -> DataFrame:
    """(mix_id, source, id, n_tokens, copies) of every record drawn at least once.

    ``records``: id, source, n_tokens; ``targets``: mix_id, source, target_share, max_repeats (a small list).
    """
    rows = records.filter("source is not null and n_tokens > 0").select(F.col(id_col).alias("_id"), "source", "n_tokens")
    plan = _expected(rows, targets.select("mix_id", "source", "target_share", "max_repeats").distinct())
    plan = cut(
        plan.select(
            "mix_id",
            "source",
            F.floor(F.col("_copies") + EPS).cast("int").alias("_base"),
            F.greatest(F.col("_copies") - F.floor(F.col("_copies") + EPS), F.lit(0.0)).alias("_p"),
            (F.col("_count") / shard_records + 1).cast("int").alias("_shards"),
        )
    )
    levels, widest = 0, plan.agg(F.max("_shards")).first()[0] or 0
    while fan_in**levels < widest:
        levels += 1
    units = rows.join(plan, "source")
    sharded = units.withColumn("_shard", F.pmod(F.xxhash64("_id", "n_tokens"), F.col("_shards")).cast("int"))
    columns = "mix_id long, source string, _id long, n_tokens long, _base int, _p double, _shard int, _extra int"

    def meet(level: int, last: bool):
        def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, level, *(zlib.crc32(str(k).encode()) for k in key)])
            p = pdf["_p"].to_numpy(float).copy()
            taken, open_at, rest = pivotal(p, rng)
            extra = taken.astype(float)
            if open_at >= 0:
                extra[open_at], p[open_at] = (float(rng.random() < rest), p[open_at]) if last else (np.nan, rest)
            pdf["_p"] = p
            pdf["_extra"] = pd.array([None if np.isnan(e) else int(e) for e in extra], dtype="Int32")
            return pdf[["mix_id", "source", "_id", "n_tokens", "_base", "_p", "_shard", "_extra"]]

        return step

    todo = sharded.select("mix_id", "source", "_id", "n_tokens", "_base", "_p", "_shard")
    done: list[DataFrame] = []
    for level in range(levels + 1):
        last = level == levels
        out = cut(spread(todo, "mix_id", "source", "_shard").groupBy("mix_id", "source", "_shard").applyInPandas(meet(level, last), columns))
        done.append(out.filter("_extra is not null"))
        todo = out.filter("_extra is null").drop("_extra").withColumn("_shard", (F.col("_shard") / fan_in).cast("int"))
    drawn = done[0]
    for more in done[1:]:
        drawn = drawn.unionByName(more)
    copies = F.col("_base") + F.col("_extra")
    return drawn.select("mix_id", "source", F.col("_id").alias(id_col), "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def mix_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, n_tokens, n_records, most_copies) of every source of every mix."""
    got = drawn.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"),
        F.count("*").alias("n_records"),
        F.max("copies").alias("most_copies"),
    )
    all_of_mix = F.sum("n_tokens").over(Window.partitionBy("mix_id"))
    return (
        targets.select("mix_id", "source", "target_share")
        .join(got, ["mix_id", "source"], "left")
        .fillna(0, ["n_tokens", "n_records", "most_copies"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("n_tokens"), all_of_mix), F.lit(0.0)))
    )
