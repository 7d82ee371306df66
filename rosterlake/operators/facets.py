"""Facet predicates, facet counts, ranges, ordinal thresholds and keyword search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(selections: dict[str, list[str]], skip: str | None = None, lists: tuple[str, ...] = ()) -> Column:
    """AND across facets, OR within one; list-valued facets by common element; facets without a selection pass."""
    out = F.lit(True)
    for facet, chosen in selections.items():
        if not chosen or facet == skip:
            continue
        if facet in lists:
            out = out & F.arrays_overlap(F.col(facet), F.array(*[F.lit(c) for c in chosen]))
        else:
            out = out & F.col(facet).isin(*chosen)
    return F.coalesce(out, F.lit(False))


def facet_counts(pool: DataFrame, facets: list[str], selections: dict[str, list[str]], lists: tuple[str, ...] = ()) -> DataFrame:
    """(facet, value, n): per value, the records left by the *other* facets' selections; null and empty values skipped.

    One scan: a record is exploded to (facet, value) pairs of the facets whose other selections it passes.
    """

    def pairs_of(f: str) -> Column:
        values = F.array_distinct(F.col(f)) if f in lists else F.array(F.col(f))
        named = F.transform(values, lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")))
        return F.when(matches(selections, skip=f, lists=lists), named)

    pairs = [pairs_of(f) for f in facets]
    rows = pool.select(F.explode(F.flatten(F.array_compact(F.array(*pairs)))).alias("x")).select("x.*")
    return rows.filter("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def keyword(columns: list[Column], query: str) -> Column:
    """Whether the lower-case search text of a record contains the query."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def in_range(value: Column, low: float, high: float, ceiling: Column, include_unknown: bool = True) -> Column:
    """Within a range whose upper handle means no limit when it stands at the ceiling of the pool; null as asked."""
    inside = (value >= low) & ((value <= high) | (F.lit(high) >= ceiling))
    return F.coalesce(inside, F.lit(include_unknown))


def at_least(value: Column, order: list[str], least: str) -> Column:
    """Whether an ordinal value stands at or above ``least``; null and unknown values do not."""
    ranks = F.array(*[F.lit(o) for o in order])
    return F.array_position(ranks, value) >= order.index(least) + 1


def options(pool: DataFrame, column: str) -> DataFrame:
    """(value): distinct values of a column or list column that are not empty."""
    values = F.explode(F.col(column)) if dict(pool.dtypes)[column].startswith("array") else F.col(column)
    return pool.select(values.alias("value")).filter("value is not null and value <> ''").distinct()


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
