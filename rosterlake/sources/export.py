"""Sinks and the content-addressed cache of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_record(records: DataFrame) -> DataFrame:
    """Nested positions as one delimited column, for flat files."""

    def shown(p: Column) -> Column:
        def text(field: str) -> Column:
            return F.coalesce(p[field], F.lit(""))

        return F.concat(text("firm"), F.lit(" - "), text("title"), F.lit(" ["), text("start_date"), F.lit(".."), text("end_date"), F.lit("]"))

    listed = F.coalesce(F.array_join(F.transform("positions", shown), " | "), F.lit(""))
    n = F.coalesce(F.when(F.col("positions").isNotNull(), F.size("positions")), F.lit(0))
    return records.withColumns({"n_positions": n, "positions": listed})


def cache_key(text: Column, *settings: str) -> Column:
    """Content key of a text and the settings it is processed with: a change of either is a new key."""
    parts = F.concat_ws("\u001f", F.coalesce(text, F.lit("")), *[F.lit(s) for s in settings])
    return F.substring(F.sha2(parts, 256), 1, 16)


def cache_misses(todo: DataFrame, cached: DataFrame, text: str, *settings: str) -> DataFrame:
    """Rows of ``todo``, with their key, whose result is not in the cache (rows with the same column and settings)."""
    keyed = todo.withColumn("cache_key", cache_key(F.col(text), *settings))
    have = cached.select(cache_key(F.col(text), *settings).alias("cache_key")).distinct()
    return keyed.join(have, "cache_key", "left_anti").select(*todo.columns, "cache_key")


def write_csv(df: DataFrame, path: str) -> None:
    """A flat CSV with a header; list columns must have been joined before."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested records, one JSON object a line."""
    df.write.mode("overwrite").json(path)
