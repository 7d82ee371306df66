"""Reading order of words placed on pages: lines, columns, and text by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lined(words: DataFrame) -> DataFrame:
    return words.withColumn("line", F.bround(F.col("top") / 3.0).cast("long"))


def group_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, line, text, n_words): words of about the same height, from left to right."""
    parts = _lined(words).groupBy(*page, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return parts.select(*page, "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.size("w").alias("n_words"))


def detect_columns(words: DataFrame, page: list[str], width: float) -> DataFrame:
    """(page, split): where a page of two columns divides, for pages that have two.

    At least 40 words; between the distinct left edges of lines the widest gap (the first of equal ones) that ends
    between 45 and 95 hundredths of the width and is 15 hundredths wide; at least 4 lines and 15 hundredths of the lines
    start right of it, and each side holds 8 hundredths of the words. The split lies 3 points left of the right edge.
    """
    lined = _lined(words)
    starts = lined.groupBy(*page, "line").agg(F.min("x0").alias("x"))
    second = lined.filter(F.col("x0") >= 0.45 * width).groupBy(*page, "line").agg(F.min("x0").alias("x"))
    edges = starts.union(second).select(*page, "x").distinct()
    order = Window.partitionBy(*page).orderBy("x")
    gap = edges.withColumn("g", F.col("x") - F.lag("x").over(order)).filter(
        (F.col("g") >= 0.15 * width) & F.col("x").between(0.45 * width, 0.95 * width)
    )
    widest = gap.groupBy(*page).agg(F.max_by("x", F.struct("g", -F.col("x"))).alias("edge"))
    both = lined.join(widest, page)
    right = F.col("x0") >= F.col("edge")
    counts = both.groupBy(*page, "edge").agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_right"),
        F.countDistinct("line").alias("lines"),
        F.countDistinct(F.when(right, F.col("line"))).alias("lines_right"),
    )
    share = F.col("n_right") / F.col("n")
    two = (F.col("n") >= 40) & (F.col("lines_right") >= 4) & (F.col("lines_right") >= 0.15 * F.col("lines")) & share.between(0.08, 0.92)
    return counts.filter(two).select(*page, (F.col("edge") - 3.0).alias("split"))


def render_columns(words: DataFrame, page: list[str], split: float | str) -> DataFrame:
    """(page, column, text, n_words): the left column's lines, then the right one's; words go by their own left edge."""
    at = F.col(split) if isinstance(split, str) else F.lit(split)
    lined = _lined(words).withColumn("column", F.when(F.col("x0") < at, 0).otherwise(1))
    lines = group_lines_of(lined, [*page, "column"])
    return lines.groupBy(*page, "column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.sum("n_words").alias("n_words"),
    )


def group_lines_of(lined: DataFrame, by: list[str]) -> DataFrame:
    parts = lined.groupBy(*by, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return parts.select(*by, "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.size("w").alias("n_words"))
