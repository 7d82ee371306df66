"""Queries of the text operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.session import table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_FLAG = ", ".join(f"'{w}'" for w in T.FLAG_STOP_WORDS)
_INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").select("candidate_id", "name", "source_file").distinct()


def text_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.loose(F.col("text"))).alias("loose_md5"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


def text_flag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "extraction_log").filter("warnings is not null")
    return w.select("source_file", F.array_join(F.array_sort(T.flag_tokens(F.col("warnings"))), " ").alias("words"))


def text_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("candidate_id", T.slug(F.col("name"), F.col("source_file")).alias("slug"))


def text_name_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("candidate_id", T.name_from_file(F.col("source_file")).alias("file_name"))


def text_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).filter("name is not null").select("candidate_id", T.display_name(F.col("name")).alias("display_name"))


def text_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short name of every candidate."""
    return _people(spark, sf_dir).select("candidate_id", T.short_name(F.col("name")).alias("short_name"))


def text_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("candidate_id", "approach_family", "market_side").distinct()
    return c.select(
        "candidate_id", T.label_of(F.col("approach_family")).alias("family"), T.label_of(F.col("market_side")).alias("side")
    )


def text_credential_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.explode(F.split("languages", ";")).alias("raw")).distinct()
    return c.select("candidate_id", "raw", T.credential_label(F.trim("raw")).alias("label"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.get("l", F.lit(0)).alias("first_line"))


def text_dedupe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("candidate_id", "software_tools").distinct()
    cells = T.dedupe_cells(F.split("software_tools", ";"))
    return c.select("candidate_id", F.array_join(cells, "|").alias("cells"))


def text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of every document's text (compatibility forms have no SQL)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.repair(F.col("text")).alias("r"))
    return d.select("doc_id", F.md5("r.text").alias("text_md5"), "r.repairs", "r.remaining")


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown headings of documents joined to candidates of that name, by folded name."""
    heads = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^## (.+)$"), F.lit(1))).alias("heading")
    )
    people = table(spark, sf_dir, "candidates").select("candidate_id", T.loose(F.col("name")).alias("key")).distinct().filter("key <> ''")
    heads = heads.withColumn("key", T.loose(F.col("heading"))).filter("key <> ''")
    found = heads.join(people, "key", "left").groupBy("doc_id", "heading")
    return found.agg(F.countDistinct("candidate_id").alias("n_people"), F.min("candidate_id").alias("candidate_id"))


def quotes_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description lines of positions that no document of the candidate contains, after loose normalisation."""
    quotes = (
        table(spark, sf_dir, "positions")
        .select("candidate_id", "pos", F.posexplode("description").alias("line", "quote"))
        .distinct()
        .withColumn("needle", T.loose(F.col("quote")))
        .filter(F.length("needle") > 8)
    )
    texts = (
        table(spark, sf_dir, "documents")
        .filter("candidate_id is not null and text is not null")
        .select("candidate_id", T.loose(F.col("text")).alias("hay"))
        .distinct()
    )
    seen = quotes.join(texts, "candidate_id", "left").groupBy("candidate_id", "pos", "line", F.substring("quote", 1, 90).alias("quote"))
    return seen.agg(F.count_if(F.contains("hay", F.col("needle"))).alias("n_found")).filter("n_found = 0").drop("n_found")


QUERIES = {
    f.__name__: f
    for f in (
        text_loose, text_tokens, text_flag_tokens, text_slug, text_name_from_file, text_display_name, text_short_name,
        text_label, text_credential_label, text_lines, text_dedupe_cells, text_repair, text_sections, quotes_unverified,
    )
}

_PEOPLE = "(SELECT DISTINCT candidate_id, name, source_file FROM candidates)"
_BARE = r"regexp_replace(name, '^((dr|mr|ms|mrs|prof)\.?\s+)+', '', 'i')"
_FOLD = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
ORACLES = {
    "text_loose": f"SELECT doc_id, md5({_FOLD.format('text')}) AS loose_md5 FROM documents",
    "text_tokens": f"""
        WITH t AS (SELECT doc_id, text, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#]{{2,}}')),
                          lambda x: x NOT IN ({_STOP})) AS t FROM documents)
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(t) END AS n,
               CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(array_to_string(list_sort(t), ' '), '')) END AS tokens_md5 FROM t""",
    "text_flag_tokens": f"""
        SELECT source_file, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(warnings), '[a-z]{{4,}}')),
               lambda x: x NOT IN ({_FLAG}))), ' ') AS words FROM extraction_log WHERE warnings IS NOT NULL""",
    "text_slug": rf"""
        SELECT candidate_id, regexp_replace(regexp_replace(lower(coalesce(nullif(name, ''), regexp_replace(source_file, '\.[^.]*$', ''))),
               '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {_PEOPLE}""",
    "text_name_from_file": rf"""
        WITH b AS (SELECT candidate_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_file, '\.[^.]*$', ''),
               '[_-]+', ' ', 'g'), '\b(resume|cv|final|updated|[0-9]{{4,}})\b', ' ', 'gi'), '\s+', ' ', 'g')) AS n FROM {_PEOPLE})
        SELECT candidate_id, {_INITCAP.format("n")} AS file_name FROM b""",
    "text_display_name": f"""
        WITH b AS (SELECT candidate_id, {_BARE} AS n FROM {_PEOPLE} WHERE name IS NOT NULL)
        SELECT candidate_id, CASE WHEN upper(n) = n THEN {_INITCAP.format("n")} ELSE n END AS display_name FROM b""",
    "text_label": f"""
        SELECT DISTINCT candidate_id, coalesce({_INITCAP.format("replace(approach_family, '_', ' ')")}, '—') AS family,
               coalesce({_INITCAP.format("replace(market_side, '_', ' ')")}, '—') AS side FROM candidates""",
    "text_credential_label": r"""
        WITH r AS (SELECT DISTINCT candidate_id, unnest(string_split(languages, ';')) AS raw FROM candidates),
        p AS (SELECT candidate_id, raw, trim(split_part(trim(raw), ' - ', 1)) AS code,
                     regexp_extract(trim(raw), '\(([^()]*)\)\s*$', 1) AS status FROM r)
        SELECT candidate_id, raw, CASE WHEN status = '' THEN code
               ELSE trim(regexp_replace(code, '\([^()]*\)\s*$', '')) || ' · ' || status END AS label FROM p""",
    "text_lines": r"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, len(l) AS n_lines, l[1] AS first_line FROM l""",
    "text_dedupe_cells": """
        WITH c AS (SELECT DISTINCT candidate_id, software_tools FROM candidates),
        x AS (SELECT candidate_id, list_filter(list_transform(string_split(software_tools, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM c)
        SELECT candidate_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS cells FROM x""",
    "text_sections": f"""
        WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^## (.+)$', 1)) AS heading FROM documents),
        k AS (SELECT doc_id, heading, {_FOLD.format("heading")} AS key FROM h),
        p AS (SELECT DISTINCT candidate_id, {_FOLD.format("name")} AS key FROM candidates)
        SELECT k.doc_id, k.heading, count(DISTINCT p.candidate_id) AS n_people, min(p.candidate_id) AS candidate_id
        FROM k LEFT JOIN p ON k.key = p.key WHERE k.key <> '' GROUP BY ALL""",
    "quotes_unverified": f"""
        WITH q AS (SELECT DISTINCT candidate_id, pos, description FROM positions),
        e AS (SELECT candidate_id, pos, unnest(description) AS quote, generate_subscripts(description, 1) - 1 AS line FROM q),
        n AS (SELECT *, {_FOLD.format("quote")} AS needle FROM e),
        d AS (SELECT DISTINCT candidate_id, {_FOLD.format("text")} AS hay FROM documents WHERE candidate_id IS NOT NULL AND text IS NOT NULL)
        SELECT n.candidate_id, n.pos, n.line, substr(n.quote, 1, 90) AS quote FROM n LEFT JOIN d ON n.candidate_id = d.candidate_id
        WHERE length(needle) > 8 GROUP BY ALL HAVING count(*) FILTER (WHERE contains(d.hay, n.needle)) = 0""",
}
