"""Matching records to specifications: criteria in long form, text similarity, weighted scores, exact and near results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import tokens

# How much words, shared concepts and short sentences count.
LEXICAL, CONCEPTUAL, SHORT_BELOW, SHORT_BASE, SHORT_STEP = 0.45, 0.75, 6, 0.55, 0.075
# Concepts and the phrases that stand for them.
CONCEPTS = {
    "catalyst": ["earnings", "catalyst", "event driven", "quarterly results", "guidance"],
    "coverage": ["under coverage", "coverage list", "names covered", "initiated on", "covering"],
    "valuation": ["dcf", "discounted cash flow", "price target", "valuation", "multiples"],
    "primary_research": ["management meetings", "expert network", "channel checks", "roadshow", "calling suppliers"],
    "long_short": ["long/short", "long short", "l/s", "hedging", "position sizing"],
    "programming": ["python", "c++", "c#", "java", "sql", "r", "matlab"],
    "financial_model": ["financial model", "financial models", "earnings model", "company models"],
    "derivatives": ["options", "swaps", "forwards", "futures", "volatility", "derivatives"],
}


def _pattern(phrases: list[str]) -> str:
    def escaped(p: str) -> str:
        return "".join(c if c.isalnum() or c == " " else "\\" + c for c in p)

    return "(?:^|[^a-z0-9])(?:" + "|".join(escaped(p) for p in phrases) + ")(?:[^a-z0-9]|$)"


def concepts_in(text: Column, concepts: dict[str, list[str]] | None = None) -> Column:
    """Concepts one of whose phrases stands in the text between non-alphanumerics; one literal pattern per concept."""
    low = F.lower(text)
    found = [F.when(low.rlike(_pattern(p)), F.lit(c)) for c, p in (concepts or CONCEPTS).items()]
    return F.array_compact(F.array(*found))


def sentence_table(texts: DataFrame, id_cols: list[str], text: str, least: int = 3) -> DataFrame:
    """(ids, ord, sentence, words, concepts): each line or sentence longer than ``least`` with its tags, computed once."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n|(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    rows = texts.select(*id_cols, F.posexplode(parts).alias("ord", "sentence"))
    return rows.withColumn("words", tokens(F.col("sentence"))).withColumn("concepts", concepts_in(F.col("sentence")))


def similarity(req_words: Column, req_concepts: Column, words: Column, concepts: Column) -> Column:
    """Share of the requirement's words and concepts that the sentence has, weighted, at most 1; short ones count less.

    Null where either side has no words. Not rounded.
    """
    lexical = F.size(F.array_intersect(req_words, words)) / F.size(req_words)
    shared = F.when(F.size(req_concepts) > 0, F.size(F.array_intersect(req_concepts, concepts)) / F.size(req_concepts)).otherwise(0.0)
    raw = F.least(F.lit(1.0), LEXICAL * lexical + CONCEPTUAL * shared)
    damp = F.when(F.size(words) < SHORT_BELOW, SHORT_BASE + SHORT_STEP * F.size(words)).otherwise(1.0)
    return F.when((F.size(req_words) > 0) & (F.size(words) > 0), raw * damp)


def best_sentence(requirements: DataFrame, sentences: DataFrame, on: list[str], req_id: list[str], ids: list[str]) -> DataFrame:
    """(req_id, ids, score, sentence): the best sentence of each text for each requirement, the first of equal ones.

    Requirements and texts meet on the keys ``on``; requirements carry req_words and req_concepts.
    """
    pairs = requirements.join(sentences, on)
    scored = pairs.withColumn("score", similarity(F.col("req_words"), F.col("req_concepts"), F.col("words"), F.col("concepts")))
    by = list(dict.fromkeys([*req_id, *on, *ids]))
    best = scored.filter("score > 0").groupBy(*by).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "sentence")).alias("b"))
    return best.select(*by, "b.score", "b.sentence")


def criterion(wanted: Column, name: str, passed: Column, found: Column) -> Column:
    """A criterion struct where the spec sets it, else null; an unknown outcome fails."""
    body = F.struct(F.lit(name).alias("criterion"), F.coalesce(passed, F.lit(False)).alias("passed"), found.cast("string").alias("found"))
    return F.when(F.coalesce(wanted, F.lit(False)), body)


def evaluate(pairs: DataFrame, criteria: list[Column], ids: list[str]) -> DataFrame:
    """(ids, criterion, passed, found) in long form: one row per criterion that the spec sets."""
    return pairs.select(*ids, F.inline(F.array_compact(F.array(*criteria))))


def grouped(pairs: DataFrame, criteria: list[Column], score: Column, ids: list[str], spec: str) -> DataFrame:
    """Exact (no criterion failed) and near (exactly one) results with their failed criterion, score and rank.

    Evaluated within the row, so no shuffle precedes the ranking window; results are ranked per spec and group by
    falling score, then by the ids.
    """
    failed = F.filter(F.array_compact(F.array(*criteria)), lambda c: ~c["passed"])
    rows = pairs.select(*ids, failed.alias("_f"), score.alias("score")).filter(F.size("_f") <= 1)
    rows = rows.withColumn("result", F.when(F.size("_f") == 0, "exact").otherwise("near"))
    order = Window.partitionBy(spec, "result").orderBy(F.desc("score"), *ids)
    return rows.select(*ids, "result", F.get("_f", F.lit(0))["criterion"].alias("gap"), "score", F.row_number().over(order).alias("rank"))


def weighted(parts: list[tuple[Column, Column]]) -> Column:
    """Mean of scores by weight over the parts that count (weight above 0); 0 where none does."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for s, w in parts:
        use = F.coalesce(w, F.lit(0.0)) > 0
        top = top + F.when(use, F.coalesce(s, F.lit(0.0)) * w).otherwise(0.0)
        bottom = bottom + F.when(use, w).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def depth(have: Column, bench: Column, default: int = 40) -> Column:
    """Share of a benchmark reached, at most 1; a missing benchmark counts as the default, one of 0 as not applicable."""
    b = F.coalesce(bench, F.lit(default))
    return F.least(F.lit(1.0), F.try_divide(F.coalesce(have, F.lit(0)).cast("double"), F.nullif(b, F.lit(0))))


def overlap_share(wanted: Column, have: Column) -> Column:
    """Share of the wanted terms that contain, or are contained in, one that is there; null where none is wanted."""
    hit = F.filter(wanted, lambda w: F.exists(have, lambda h: F.contains(h, w) | F.contains(w, h)))
    return F.try_divide(F.size(hit), F.nullif(F.size(wanted), F.lit(0)))
