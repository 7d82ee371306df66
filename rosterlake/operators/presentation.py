"""Rows and texts for readers: score ledgers, result lines, letters, positions with their links, stamped flags, help texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(rows: DataFrame, ids: list[str], parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(ids, part, score, weight, active, place): parts that count by falling weight, then the idle ones."""
    body = [
        F.struct(F.lit(n).alias("part"), s.cast("double").alias("score"), F.coalesce(w, F.lit(0.0)).alias("weight"))
        for n, (s, w) in parts.items()
    ]
    long = rows.select(*ids, F.inline(F.array(*body))).withColumn("active", F.col("weight") > 0)
    order = Window.partitionBy(*ids).orderBy(F.desc("active"), F.desc("weight"), "part")
    return long.withColumn("place", F.row_number().over(order))


def result_line(parts: list[Column], gap: Column) -> Column:
    """The known parts of a record joined, and the one gap of a near result."""
    known = F.concat_ws(" · ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.when(gap.isNotNull(), F.concat(known, F.lit(" — misses "), gap)).otherwise(known)


def letter(name: Column, contact: Column, verdict: Column, signals: Column, quote: Column) -> Column:
    """A letter's lines: identity, contact, verdict, signals and a quote of at most 180 characters; missing ones left out."""
    cut = F.when(F.length(quote) > 180, F.concat(F.substring(quote, 1, 180), F.lit("…"))).otherwise(quote)
    return F.concat_ws("\n", name, contact, verdict, F.nullif(signals, F.lit("")), cut)


def linked_positions(positions: DataFrame, links: DataFrame) -> DataFrame:
    """Positions with the firm their raw name is linked to; of several links of one raw name the last one counts."""
    last = links.groupBy("raw").agg(F.max_by("canonical", "ord").alias("canonical"))
    return positions.join(last, F.col("firm") == F.col("raw"), "left").drop("raw")


def shown_dates(start: Column, end: Column, current: Column, months: Column) -> Column:
    """Dates of a position for readers; only the duration where no date is known."""
    until = F.when(F.coalesce(current, F.lit(False)), "present").otherwise(F.coalesce(end, F.lit("?")))
    return F.when(start.isNotNull(), F.concat(start, F.lit(" to "), until)).when(months.isNotNull(), F.concat(months, F.lit(" months")))


def stamp_flags(flags: Column, source: str, has_location: Column) -> Column:
    """Flags with their source; those of a model become warnings, a missing location that is known after all becomes a note."""
    model = source == "model"

    def stamped(f: Column) -> Column:
        note = has_location & F.lower(f["summary"]).contains("location") & (f["category"] == "missing_data")
        severity = F.lit("warning") if model else f["severity"]
        return F.struct(f["category"].alias("category"), F.when(note, "info").otherwise(severity).alias("severity"), f["summary"].alias("summary"), F.lit(source).alias("source"))

    return F.transform(flags, stamped)


def help_text(keys: DataFrame, texts: dict[str, str], key: str) -> DataFrame:
    """(key, help): a text per key, empty where there is none."""
    book = F.create_map(*[F.lit(x) for p in texts.items() for x in p])
    return keys.select(key, F.coalesce(F.try_element_at(book, F.col(key)), F.lit("")).alias("help"))
