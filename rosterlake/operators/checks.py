"""Rule checks as flag arrays, flag merging and ordering, capped-penalty scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import flag_tokens

# Order of flag categories in a list.
PRIORITY = [
    "internal_contradiction", "date_anomaly", "attribution_ambiguity", "missing_data", "typo_or_spelling", "formatting", "other",
]
# Topics of which a computed check finds everything, by words of the summary; the first that matches.
TOPICS = [
    ("email", r"email.*(malformed|missing|invalid|domain|suffix|format)|(malformed|missing|invalid).*email"),
    ("phone", r"phone.*(malformed|missing|invalid|format|digits)|(malformed|missing|invalid).*phone"),
    ("gap", r"\bgaps?\b"),
    ("overlap", r"\boverlap|\bconcurrent\b"),
    ("series_pair", r"\bseries\s*8[67]\b"),
]
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"


def flag(when: Column, category: str, severity: str, summary: Column | str) -> Column:
    """A flag struct where the condition holds, else null (a null condition raises no flag)."""
    text = F.lit(summary) if isinstance(summary, str) else summary
    body = F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), text.alias("summary"))
    return F.when(F.coalesce(when, F.lit(False)), body)


def flags(*candidates: Column) -> Column:
    """The flags that were raised, in the given order."""
    return F.array_compact(F.array(*candidates))


def contact_flags(email: Column) -> Column:
    """Missing or malformed e-mail address; the two malformed cases are told apart."""
    blank = F.coalesce(F.trim(email), F.lit("")) == ""
    bad = ~blank & ~F.trim(email).rlike(EMAIL)
    return flags(
        flag(blank, "missing_data", "warning", "no e-mail address"),
        flag(bad & ~F.contains(email, F.lit("@")), "formatting", "warning", "e-mail address without @"),
        flag(bad & F.contains(email, F.lit("@")), "formatting", "warning", "e-mail address is not well formed"),
    )


def extraction_flags(log: DataFrame) -> Column:
    """Warnings from extraction diagnostics: thin text, text boxes, tables, columns, damaged characters."""
    return flags(
        flag(F.col("char_count") < 1000, "formatting", "warning", F.format_string("thin text: %d characters", F.col("char_count"))),
        flag(F.col("textbox_count") > 0, "formatting", "info", F.format_string("%d text boxes", F.col("textbox_count"))),
        flag(F.col("table_share") > 0.5, "formatting", "info", "mostly tables"),
        flag(F.col("multi_column_detected"), "formatting", "info", "several columns"),
        flag(F.col("replacement_chars_remaining") > 0, "formatting", "warning", F.format_string("%d damaged characters", F.col("replacement_chars_remaining"))),
    )


def tenure_flags(total: Column, part: Column) -> Column:
    """No investing years at all, or at least two years spent otherwise."""
    return flags(
        flag(part == 0, "other", "info", "no investing years"),
        flag((part > 0) & (total - part >= 2.0), "other", "info", "two years or more outside investing"),
    )


def paired_codes(text: Column, first: str, second: str) -> Column:
    """Whether exactly one of two codes that belong together is named after "series"."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"series\s*(\d+)"), F.lit(1))
    return F.array_contains(found, first) != F.array_contains(found, second)


def postcode_mismatch(city: Column, code: Column, prefixes: Column) -> Column:
    """Whether a city with known postcode prefixes stands with a code of none of them."""
    return prefixes.isNotNull() & (code != "") & ~F.exists(prefixes, lambda p: F.startswith(code, p))


def topic(summary: Column) -> Column:
    """Topic of a flag by its summary; null where no topic matches."""
    out = F.when(summary.isNull(), None)
    for name, pattern in TOPICS:
        out = out.when(F.lower(summary).rlike(pattern), name)
    return out


def group_of(category: Column, summary: Column) -> Column:
    """Heading under which a flag is shown."""
    return (
        F.when(F.lower(summary).rlike("e-?mail|phone|contact"), "Contact")
        .when(category.isin("internal_contradiction", "attribution_ambiguity"), "Possible misrepresentation")
        .when(category == "date_anomaly", "Timeline")
        .otherwise("Detail")
    )


def merge_flags(first: Column, more: Column) -> Column:
    """``first`` with those of ``more`` that say something new.

    A flag is dropped if its topic is covered by ``first``, or if one accepted so far has its category and shares half
    of the smaller word set or more; flags without words match nothing. The fold is sequential, as order decides.
    """
    covered = F.transform(first, lambda f: F.coalesce(topic(f["summary"]), F.lit("")))

    def similar(a: Column, f: Column) -> Column:
        x, y = flag_tokens(a["summary"]), flag_tokens(f["summary"])
        least = F.least(F.size(x), F.size(y))
        return (a["category"] == f["category"]) & (least > 0) & (F.size(F.array_intersect(x, y)) * 2 >= least)

    def step(acc: Column, f: Column) -> Column:
        known = F.array_contains(covered, F.coalesce(topic(f["summary"]), F.lit("-")))
        return F.when(known | F.exists(acc, lambda a: similar(a, f)), acc).otherwise(F.array_append(acc, f))

    return F.aggregate(more, first, step)


def sort_flags(all_flags: Column) -> Column:
    """Warnings first, then by category priority, else in the given order."""
    rank = F.array(*[F.lit(c) for c in PRIORITY])
    keyed = F.transform(
        all_flags,
        lambda f, i: F.struct(
            (f["severity"] != "warning").alias("s"),
            F.coalesce(F.nullif(F.array_position(rank, f["category"]), F.lit(0)), F.lit(99)).alias("p"),
            i.alias("i"),
            f.alias("f"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def triage(flag_rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Flags with the reviews (key, match, note) whose text their summary contains: severity info, notes joined in order."""
    r = reviews.select(F.col(key), "match", "note", "ord")
    hit = flag_rows.join(r, key, "left").withColumn("note", F.when(F.contains(F.lower("summary"), F.lower("match")), F.col("note")))
    by = [c for c in flag_rows.columns if c != "severity"]
    out = hit.groupBy(*by, "severity").agg(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("ord", "note")))).alias("n"))
    return out.select(
        *by, F.when(F.size("n") > 0, "info").otherwise(F.col("severity")).alias("severity"), F.array_join(F.transform("n", lambda x: x["note"]), "; ").alias("notes")
    )


def capped_score(deductions: list[tuple[Column, int | None]]) -> Column:
    """100 minus the deductions (each with its cap, in hundredths), kept within 0 and 100; whole numbers, no rounding."""
    total = F.lit(0)
    for amount, cap in deductions:
        d = F.coalesce(amount, F.lit(0))
        total = total + (F.least(d, F.lit(cap)) if cap is not None else d)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - total))


def score_band(score: Column, high: int = 80, medium: int = 55) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
