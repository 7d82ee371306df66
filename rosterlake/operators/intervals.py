"""Interval algebra over dated histories, as windows and keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame, as_of: int, start: str = "s", end: str = "e", current: str = "is_current") -> DataFrame:
    """Rows with ``end`` capped at ``as_of`` (also for current and open ones), those that do not end after they start left out."""
    e = F.when(F.coalesce(current, F.lit(False)), F.lit(as_of)).otherwise(F.least(F.coalesce(end, F.lit(as_of)), F.lit(as_of)))
    return rows.withColumn(end, e).filter(F.col(end) > F.col(start))


def union_length(rows: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """(key, months): total length of the union of the intervals of a key; touching intervals merge."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_before", before).withColumn("_gain", F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_before", F.col(start))), F.lit(0)))
    return fresh.groupBy(key).agg(F.sum("_gain").alias("months"))


def years_of_experience(
    positions: DataFrame, key: str, as_of: int, qualifies: Column, start: str = "s", end: str = "e", duration: str = "duration_months"
) -> DataFrame:
    """(key, years): union of the qualifying dated positions plus the durations of undated ones, in years to one place.

    0.0 where nothing qualifies but some position has a date; null where no position has one.
    """
    dated = spans(positions.filter(qualifies & F.col(start).isNotNull()), as_of, start, end)
    months = union_length(dated, key, start, end)
    loose = positions.filter(qualifies & F.col(start).isNull()).groupBy(key).agg(F.sum(duration).alias("extra"))
    known = positions.groupBy(key).agg(F.max(F.col(start).isNotNull()).alias("datable"))
    total = F.coalesce("months", F.lit(0)) + F.coalesce("extra", F.lit(0))
    return (
        known.join(months, key, "left")
        .join(loose, key, "left")
        .select(key, F.when(F.col("months").isNotNull() | F.col("extra").isNotNull() | F.col("datable"), F.bround(total / 12, 1)).alias("years"))
    )


def gaps(rows: DataFrame, key: str, least: int, start: str = "s", end: str = "e") -> DataFrame:
    """(key, gap_start, gap_end, months) of every gap of at least ``least`` months after the latest end so far."""
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.select(key, start, end).distinct().withColumn("_end", F.max(end).over(order))
    return seen.filter(F.col(start) - F.col("_end") >= least).select(
        key, F.col("_end").alias("gap_start"), F.col(start).alias("gap_end"), (F.col(start) - F.col("_end")).alias("months")
    )


def concurrent(rows: DataFrame, key: str, order: str, least: int, start: str = "s", end: str = "e") -> DataFrame:
    """(key, first, second, months): pairs of intervals of a key that overlap by at least ``least`` months.

    Months are cut into blocks so that a key with very many intervals spreads over tasks: two intervals meet in every
    block both touch and the pair is kept in the first of these only.
    """
    block = 24
    cut = rows.select(key, order, start, end).distinct()
    cut = cut.withColumn("_b", F.explode(F.sequence((F.col(start) / block).cast("int"), ((F.col(end) - 1) / block).cast("int"))))
    a = cut.select(key, "_b", F.col(order).alias("first"), F.col(start).alias("s1"), F.col(end).alias("e1"))
    b = cut.select(key, "_b", F.col(order).alias("second"), F.col(start).alias("s2"), F.col(end).alias("e2"))
    meet = F.least("e1", "e2") - F.greatest("s1", "s2")
    pairs = a.join(b, [key, "_b"]).filter((F.col("first") < F.col("second")) & (meet >= least))
    first_block = (F.greatest("s1", "s2") / block).cast("int")
    return pairs.filter(F.col("_b") == first_block).select(key, "first", "second", meet.alias("months"))


def first_overlap(left: DataFrame, right: DataFrame, key: str, least: int) -> DataFrame:
    """For each row of ``left`` (key, id, s, e) the first row of ``right`` by start that overlaps it ``least`` months or more."""
    r = right.select(key, F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    meet = F.least("e", "e2") - F.greatest("s", "s2")
    found = left.join(r, key).filter(meet >= least).groupBy(key, "id").agg(F.min(F.struct("s2", "other", meet.alias("months"))).alias("m"))
    return found.select(key, "id", "m.other", "m.months")


def month_text(index: Column) -> Column:
    """``YYYY-MM`` of a year * 12 + month number (December belongs to its own year)."""
    m = index - 1
    return F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"))
