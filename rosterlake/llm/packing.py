"""Pack items of varying length into containers of fixed capacity under several limits at once.

Vector bin packing by the dot-product heuristic: an open container takes, of the items that still fit, the one whose
size vector (tokens, segments, loss-bearing tokens, each relative to its limit) points most in the direction of the room
left (the dot product of the item's unit vector with the room), larger items being preferred by a share of their length,
until none fits. Unit vectors let small and large items of a container balance each other, where plain dot products
would use up the large ones first and leave containers of small items bound by their number. Items longer than the capacity, and only those, are cut into pieces of the capacity.

Items are packed in shards of bounded size by a hash of their id, so a hot group spreads over tasks; containers that a
shard leaves insufficiently filled are dissolved and their items packed again in new shards, as long as that saves
containers. :func:`near_mean_limits` sets limits on segments and loss-bearing tokens close to what an average container
holds, so that all three limits bind and the items of a container have to balance each other.

Defined results: an item of no tokens takes no container (container_id null); a null size counts as 0; repeated ids
are items of their own; a piece whose loss-bearing tokens alone exceed their limit gets a container of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import cut, spread


def pack_group(sizes: np.ndarray, limits: np.ndarray, prefer: float = 0.3) -> np.ndarray:
    """Container number of each row of ``sizes`` (items x dimensions) under ``limits``."""
    n = len(sizes)
    order = np.argsort(-sizes[:, 0], kind="stable")
    scaled = (sizes / limits)[order]
    # A limit of which the items ask less than half as much as of the scarcest one gives no direction.
    scarce = scaled.sum(axis=0) >= 0.5 * scaled.sum(axis=0).max()
    length = np.maximum(np.sqrt((scaled[:, scarce] ** 2).sum(axis=1)), 1e-12)
    unit, bonus = scaled * scarce / length[:, None], prefer * length
    where = np.full(n, -1, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    bin_no, left = 0, n
    first = 0
    while left:
        while not alive[first]:
            first += 1
        room = 1.0 - scaled[first]
        alive[first], where[first] = False, bin_no
        left -= 1
        idx = np.flatnonzero(alive)
        fit = idx[(scaled[idx] <= room + 1e-9).all(axis=1)]
        while len(fit):
            best = fit[np.argmax(unit[fit] @ room + bonus[fit])]
            room = room - scaled[best]
            alive[best], where[best] = False, bin_no
            left -= 1
            fit = fit[fit != best]
            fit = fit[(scaled[fit] <= room + 1e-9).all(axis=1)]
        bin_no += 1
    out = np.empty(n, dtype=np.int64)
    out[order] = where
    return out


def _pieces(items: DataFrame, specs: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """Every piece of every item of every spec, with the spec's columns."""
    sized = items.select(
        F.col(id_col).alias("_id"),
        F.col(group_col).alias("_group"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("_tokens"),
        F.coalesce("n_prompt", F.lit(0)).cast("long").alias("_prompt"),
    )
    wanted = sized.join(specs, F.col("doc_group").isNull() | (F.col("doc_group") == F.col("_group")))
    cap = F.col("capacity_tokens").cast("long")
    last = F.greatest(F.ceil(F.col("_tokens") / cap) - 1, F.lit(0)).cast("int")
    return (
        wanted.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("_start", F.col("_piece") * cap)
        .withColumn("_n", F.least(F.col("_tokens") - F.col("_start"), cap))
        .withColumn("_loss", F.greatest(F.col("_start") + F.col("_n") - F.greatest("_start", "_prompt"), F.lit(0)))
    )


def near_mean_limits(items: DataFrame, specs: DataFrame, slack: float = 1.3, id_col: str = "doc_id", group_col: str = "doc_type") -> DataFrame:
    """``specs`` with max_segments and max_loss: what a full container of average items holds, times ``slack``."""
    spec = specs.filter("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens", "doc_group").distinct()
    sums = _pieces(items, spec, id_col, group_col).filter("_n > 0").groupBy("spec_id").agg(
        F.count("*").alias("n"), F.sum("_n").alias("tokens"), F.sum("_loss").alias("loss")
    )
    cap = F.col("capacity_tokens")
    return spec.join(sums, "spec_id", "left").select(
        "spec_id",
        "capacity_tokens",
        "doc_group",
        F.ceil(slack * cap * F.col("n") / F.col("tokens")).cast("double").alias("max_segments"),
        F.least(cap.cast("double"), slack * cap * F.col("loss") / F.col("tokens")).alias("max_loss"),
    )


def pack(
    items: DataFrame,
    specs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "doc_type",
    tokens_per_segment: int = 16,
    loss_share: float = 1.0,
    shard_items: int = 4096,
    full_enough: float = 0.97,
) -> DataFrame:
    """(spec_id, container_id, id, piece, start_token, n_tokens, n_loss) for every piece of every item of every spec.

    ``items``: id, group, n_tokens, n_prompt; ``specs``: spec_id, capacity_tokens, doc_group (null: all items), and maybe
    max_segments and max_loss. A container holds at most capacity_tokens tokens, max_segments segments and max_loss
    loss-bearing tokens; where a spec names none, capacity_tokens / ``tokens_per_segment`` and ``loss_share`` of the capacity.
    """
    cap = F.col("capacity_tokens")
    own = [c if c in specs.columns else F.lit(None).cast("double").alias(c) for c in ("max_segments", "max_loss")]
    spec = (
        specs.filter("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens", "doc_group", *own).distinct()
        .withColumn("max_segments", F.greatest(F.lit(1.0), F.coalesce("max_segments", F.floor(cap / tokens_per_segment).cast("double"))))
        .withColumn("max_loss", F.greatest(F.lit(1.0), F.coalesce("max_loss", cap * loss_share)))
    )
    columns = ["spec_id", "capacity_tokens", "max_segments", "max_loss", "_id", "_piece", "_start", "_n", "_loss"]
    pieces = cut(_pieces(items, spec, id_col, group_col).select(*columns))
    schema = (
        "spec_id long, capacity_tokens int, max_segments double, max_loss double, _id long, _piece int, _start long, _n long, _loss long, "
        "_container string, _fill double"
    )

    def one_round(todo: DataFrame, name: str) -> DataFrame:
        counts = todo.groupBy("spec_id").agg((F.count("*") / shard_items + 1).cast("int").alias("_shards"))
        where = F.pmod(F.xxhash64("_id", "_piece", F.lit(name)), F.col("_shards"))

        def packer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            capacity = float(pdf["capacity_tokens"].iloc[0])
            limits = np.array([capacity, pdf["max_segments"].iloc[0], pdf["max_loss"].iloc[0]])
            pdf = pdf.sort_values(["_n", "_id", "_piece"], ascending=[False, True, True], kind="stable")
            sizes = np.column_stack([pdf["_n"], np.ones(len(pdf)), pdf["_loss"]]).astype(float)
            box = pack_group(sizes, limits)
            used = np.bincount(box, weights=sizes[:, 0])
            out = pdf.drop(columns=["_shard"]).copy()
            out["_container"] = [f"{key[0]}-{name}-{key[1]}-{b}" for b in box]
            out["_fill"] = used[box] / capacity
            return out

        sharded = todo.join(counts, "spec_id").withColumn("_shard", where).drop("_shards").select(*columns, "_shard")
        return cut(spread(sharded, "spec_id", "_shard").groupBy("spec_id", "_shard").applyInPandas(packer, schema))

    def containers(some: DataFrame) -> int:
        return some.select("_container").distinct().count()

    kept: list[DataFrame] = []
    packed, turn = one_round(pieces.filter("_n > 0"), "r0"), 0
    low = packed.filter(F.col("_fill") < full_enough)
    while (before := containers(low)) > 1:
        turn += 1
        again = one_round(low.select(*columns), f"r{turn}")
        if containers(again) >= before:  # nothing saved: the containers stay as they were
            break
        kept.append(packed.filter(F.col("_fill") >= full_enough))
        packed = again
        low = packed.filter(F.col("_fill") < full_enough)
    empty = pieces.filter("_n <= 0").withColumn("_container", F.lit(None).cast("string")).withColumn("_fill", F.lit(0.0))
    out = packed.unionByName(empty)
    for some in kept:
        out = out.unionByName(some)
    return out.select(
        "spec_id",
        F.col("_container").alias("container_id"),
        F.col("_id").alias(id_col),
        F.col("_piece").alias("piece"),
        F.col("_start").alias("start_token"),
        F.col("_n").alias("n_tokens"),
        F.col("_loss").alias("n_loss"),
    )


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, n_containers, n_pieces, n_tokens, fill) of each spec: how full its containers are.

    Of specs with max_segments and max_loss also how much of each limit an average container uses, and the share of
    containers that reach 98 percent of a limit: segments_use, loss_use, tokens_bind, segments_bind, loss_bind.
    """
    limits = [c for c in ("max_segments", "max_loss") if c in specs.columns]
    used = packed.filter("container_id is not null").groupBy("spec_id", "container_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.sum("n_loss").alias("n_loss")
    )
    more = []
    if limits:
        used = used.join(specs.select("spec_id", F.col("capacity_tokens").alias("cap"), *limits), "spec_id")
        parts = {"tokens": F.col("n_tokens") / F.col("cap"), "segments": F.col("n_pieces") / F.col("max_segments"), "loss": F.col("n_loss") / F.col("max_loss")}
        more = [F.avg(v).alias(f"{n}_use") for n, v in parts.items() if n != "tokens"] + [F.avg((v >= 0.98).cast("double")).alias(f"{n}_bind") for n, v in parts.items()]
    total = used.groupBy("spec_id").agg(
        F.count("*").alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), *more
    )
    return specs.select("spec_id", "capacity_tokens").join(total, "spec_id", "left").withColumn(
        "fill", F.try_divide(F.col("n_tokens"), F.col("n_containers") * F.col("capacity_tokens"))
    )
