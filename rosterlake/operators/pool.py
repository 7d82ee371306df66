"""Aggregates over a pool of records: matrices with totals, top lists, rarity, networks, rankings, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matrix(pool: DataFrame, group: str, values: str, key: str) -> DataFrame:
    """(grp, value, n) with totals (null grp: column total, null value: row total).

    A record counts once per value. Records without a group count in the column totals only. One pass with grouping
    sets for cells and column totals; row totals count records, not values.
    """
    once = pool.select(key, group, F.array_distinct(values).alias("_v"))
    cells = once.select(F.col(group).alias("grp"), F.explode("_v").alias("value")).groupBy("grp", "value").agg(F.count("*").alias("n"))
    columns = cells.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("grp"), "value", "n")
    known = F.coalesce(F.trim("grp"), F.lit("")) != ""
    rows = once.filter(F.coalesce(F.trim(group), F.lit("")) != "").groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    rows = rows.select("grp", F.lit(None).cast("string").alias("value"), "n")
    return cells.filter(known).unionByName(columns).unionByName(rows)


def top_values(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n most frequent values; of equally frequent ones those seen first by ``order``."""
    counts = rows.filter(F.col(value) != "").groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen", value).limit(n).select(value, "n")


def rarity_tags(pool: DataFrame, traits: list[tuple[str, Column]], share: float, most: int, key: str) -> DataFrame:
    """(key, tags): up to ``most`` traits, in the given order, that less than ``share`` of the pool has."""
    marks = [F.coalesce(c, F.lit(False)).alias(f"_t{i}") for i, (_, c) in enumerate(traits)]
    marked = pool.select(key, *marks)
    shares = marked.agg(*[F.avg(F.col(f"_t{i}").cast("int")).alias(f"_s{i}") for i in range(len(traits))])
    both = marked.crossJoin(F.broadcast(shares))  # one row of shares
    tags = [F.when(F.col(f"_t{i}") & (F.col(f"_s{i}") < share), F.lit(name)) for i, (name, _) in enumerate(traits)]
    return both.select(key, F.array_join(F.slice(F.array_compact(F.array(*tags)), 1, most), "; ").alias("tags"))


def upper_rank(values: DataFrame, column: str, part: float = 0.5) -> DataFrame:
    """(value): the element at floor(n * part) of the sorted values (not interpolated), without gathering them.

    The counts per distinct value are cumulated, so only distinct values pass through the window.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.floor(F.sum("n") * part).alias("_k"))
    upto = counts.withColumn("_upto", F.sum("n").over(Window.orderBy(column)))
    return upto.crossJoin(F.broadcast(total)).filter("_upto > _k").agg(F.min(column).alias("value"))


def band_counts(rows: DataFrame, band: str, bands: list[str]) -> DataFrame:
    """(band, n) of every band, also those that do not occur."""
    counted = rows.agg(*[F.count_if(F.col(band) == b).alias(b) for b in bands])
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in bands])
    return counted.select(F.inline(pairs))


def confusion(labelled: DataFrame, spec: str, label: str, predicted: str) -> DataFrame:
    """Counts and ratios per spec and overall (null spec); borderline labels set aside; ratios null where undefined."""
    yes, no = F.col(label) == "yes", F.col(label) == "no"
    hit = F.coalesce(F.col(predicted), F.lit(False))
    counts = labelled.rollup(spec).agg(
        F.count_if(yes & hit).alias("tp"),
        F.count_if(no & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
        F.count_if(no & ~hit).alias("tn"),
        F.count_if(F.col(label) == "borderline").alias("borderline"),
    )
    judged = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumn("judged", judged).select(
        "*",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("tp") + F.col("tn"), judged).alias("agreement"),
    )


def network_edges(members: DataFrame, firms: DataFrame) -> DataFrame:
    """(a, b, kind): employment edges person to firm, and parent edges firm to parent."""
    work = members.select(F.col("person").alias("a"), F.col("canonical").alias("b"), F.lit("employment").alias("kind"))
    up = firms.filter("parent is not null").join(members.select("canonical").distinct(), "canonical", "left_semi")
    return work.distinct().unionByName(up.select(F.col("canonical").alias("a"), F.col("parent").alias("b"), F.lit("parent").alias("kind")))


def layout(nodes: DataFrame, layer: str, node: str) -> DataFrame:
    """(layer, node, y): nodes of a layer evenly spread in name order, (i + 0.5) / n."""
    w = Window.partitionBy(layer)
    i = F.row_number().over(w.orderBy(node)) - 1
    return nodes.select(layer, node, ((i + 0.5) / F.count("*").over(w)).alias("y"))
