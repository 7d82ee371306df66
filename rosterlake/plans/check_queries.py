"""Queries of the rule checks, flags and scores over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import checks as C
from rosterlake.operators.pool import band_counts
from rosterlake.operators.resolve import band_of, first_match, resolve_names
from rosterlake.plans.common import BANDS, SQL_BAND, TITLE_HINTS, people, quoted
from rosterlake.plans.resolve_queries import ORACLES as RESOLVE
from rosterlake.plans.resolve_queries import _hint_case
from rosterlake.session import table

REVIEWS = [("text box", "seen by a reader"), ("table", "layout only"), ("ligature", "repaired"), ("page", "checked")]


def _summaries(flags: str = "f") -> list:
    return [F.col(f"{flags}.category").alias("category"), F.col(f"{flags}.severity").alias("severity"), F.col(f"{flags}.summary").alias("summary")]


def contact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "email")
    return c.select("candidate_id", F.explode(C.contact_flags(F.col("email"))).alias("f")).select("candidate_id", *_summaries())


def extraction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "extraction_log")
    return log.select("source_file", F.explode(C.extraction_flags(log)).alias("f")).select("source_file", *_summaries())


def tenure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "years_experience", "years_investment_experience")
    f = F.explode(C.tenure_flags(F.col("years_experience"), F.col("years_investment_experience"))).alias("f")
    return c.select("candidate_id", f).select("candidate_id", *_summaries())


def seniority_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current titles two bands or more away from the tenure."""
    order = ["intern", "junior", "mid", "senior", "portfolio_manager"]
    rank = F.array(*[F.lit(o) for o in order])
    t = table(spark, sf_dir, "positions").filter("is_current").select("candidate_id", "pos", "title").distinct()
    both = t.join(people(spark, sf_dir, "years_experience"), "candidate_id")
    both = both.withColumns({"hint": first_match(F.col("title"), TITLE_HINTS), "band": band_of(F.col("years_experience"), BANDS)})
    apart = F.abs(F.array_position(rank, F.col("hint")) - F.array_position(rank, F.col("band")))
    return both.filter(apart >= 2).select("candidate_id", "pos", "hint", "band", apart.cast("long").alias("apart"))


def credential_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name exactly one of Series 86 and Series 87."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", C.paired_codes(F.col("text"), "86", "87").alias("unpaired")).filter("unpaired is not null")


def postcode_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places whose postcode does not start with the commonest leading digit of that city."""
    rows = people(spark, sf_dir, "location").select(
        "candidate_id", "location", F.regexp_extract("location", r"^\s*([^,0-9]+?),?\s", 1).alias("city"), F.regexp_extract("location", r"\b(\d{5})\b", 1).alias("code")
    ).filter("code <> '' and city <> ''")
    per = rows.groupBy("city", F.substring("code", 1, 1).alias("p")).agg(F.count("*").alias("n"))
    book = per.groupBy("city").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p"))), 1, 1).alias("top"))
    book = book.select("city", F.transform("top", lambda x: x["p"]).alias("prefixes"))
    return rows.join(book, "city", "left").filter(C.postcode_mismatch(F.col("city"), F.col("code"), F.col("prefixes"))).select("candidate_id", "location", "city", "code")


def ambiguous_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions whose firm names words of several listed firms."""
    p = table(spark, sf_dir, "positions").select("candidate_id", "pos", "firm").distinct()
    found = resolve_names(p, table(spark, sf_dir, "firms")).filter("resolution = 'ambiguous'")
    return p.join(found, F.col("firm") == F.col("raw")).select("candidate_id", "pos", "firm")


def _log_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "extraction_log").filter("warnings is not null")
    parts = F.filter(F.transform(F.split("warnings", r"[|;]"), lambda x: F.trim(x)), lambda x: x != "")
    return log.select("source_file", F.posexplode(parts).alias("i", "summary"))


def flag_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _log_flags(spark, sf_dir)
    return f.select("source_file", "i", C.topic(F.col("summary")).alias("topic"), C.group_of(F.lit("formatting"), F.col("summary")).alias("heading"))


def flag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed extraction flags merged with the logged ones (a sequential fold; tested against plain Python)."""
    log = table(spark, sf_dir, "extraction_log")
    logged = F.filter(F.transform(F.split(F.coalesce("warnings", F.lit("")), r"[|;]"), lambda x: F.trim(x)), lambda x: x != "")
    more = F.transform(logged, lambda s: F.struct(F.lit("formatting").alias("category"), F.lit("warning").alias("severity"), s.alias("summary")))
    return log.select("source_file", F.explode(C.sort_flags(C.merge_flags(C.extraction_flags(log), more))).alias("f")).select("source_file", *_summaries())


def flag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction and contact flags of each candidate in display order."""
    log = table(spark, sf_dir, "extraction_log")
    own = log.select("source_file", C.extraction_flags(log).alias("a"))
    c = people(spark, sf_dir, "email", "source_file").join(own, "source_file", "left")
    both = F.concat(C.contact_flags(F.col("email")), F.coalesce("a", F.array().cast("array<struct<category:string,severity:string,summary:string>>")))
    return c.select("candidate_id", F.array_join(F.transform(C.sort_flags(both), lambda x: x["summary"]), " | ").alias("ordered"))


def flag_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged flags after review: those a review's text matches become notes."""
    files = table(spark, sf_dir, "extraction_log").select("source_file").distinct()
    reviews = spark.createDataFrame([(*r, i) for i, r in enumerate(REVIEWS)], "match string, note string, ord int")
    per_file = files.join(F.broadcast(reviews), F.lit(True))  # four reviews for every file: a fixed list
    rows = _log_flags(spark, sf_dir).withColumn("severity", F.lit("warning"))
    return C.triage(rows, per_file, "source_file")


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "extraction_log").select("source_file", "char_count", "replacement_chars_remaining").groupBy("source_file").agg(
        F.min("char_count").alias("char_count"), F.max("replacement_chars_remaining").alias("damaged")
    )
    c = people(spark, sf_dir, "name", "location", "email", "n_positions", "flag_count", "approach_confidence", "source_file").join(log, "source_file", "left")

    def blank(name: str):
        return F.coalesce(F.trim(name), F.lit("")) == ""

    score = C.capped_score(
        [
            (F.when(blank("name"), 15), None),
            (F.when(F.coalesce("n_positions", F.lit(0)) == 0, 40), None),
            (F.when(blank("location"), 10), None),
            (F.when(F.col("approach_confidence") == "low", 5), 15),
            (F.when(F.col("char_count") < 1500, 20), None),
            (F.col("flag_count") * 4, 25),
        ]
    )
    return c.select("candidate_id", score.alias("score")).withColumn("band", C.score_band(F.col("score")))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir)


def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_counts(_score(spark, sf_dir), "band", ["high", "medium", "low"])


def record_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of flags and warnings of each extraction, and the note made of them."""
    log = table(spark, sf_dir, "extraction_log")
    f = log.select("source_file", C.extraction_flags(log).alias("f")).select(
        "source_file", F.size("f").alias("flags"), F.size(F.filter("f", lambda x: x["severity"] == "warning")).alias("warnings")
    )
    return f.withColumn("note", F.concat_ws(", ", F.when(F.col("flags") > 0, F.concat("flags", F.lit(" flags"))), F.when(F.col("warnings") > 0, F.concat("warnings", F.lit(" warnings")))))


QUERIES = {
    f.__name__: f
    for f in (
        contact_check, extraction_warnings, tenure_split, seniority_mismatch, credential_pairs, postcode_check, ambiguous_employers,
        flag_topics, flag_merge, flag_order, flag_triage, quality_score, quality_bands, record_notes,
    )
}

_CONTACT = r"""contact AS (
  SELECT candidate_id, CASE WHEN blank THEN 'missing_data' ELSE 'formatting' END AS category, 'warning' AS severity,
         CASE WHEN blank THEN 'no e-mail address' WHEN NOT contains(email, '@') THEN 'e-mail address without @'
              ELSE 'e-mail address is not well formed' END AS summary
  FROM (SELECT DISTINCT candidate_id, email, coalesce(trim(email), '') = '' AS blank FROM candidates)
  WHERE blank OR NOT regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[A-Za-z]{2,}'))"""
_EXTRACT = """extraction AS (
  SELECT source_file, 1 AS o, 'formatting' AS category, 'warning' AS severity, 'thin text: ' || char_count || ' characters' AS summary
  FROM extraction_log WHERE char_count < 1000
  UNION ALL SELECT source_file, 2, 'formatting', 'info', textbox_count || ' text boxes' FROM extraction_log WHERE textbox_count > 0
  UNION ALL SELECT source_file, 3, 'formatting', 'info', 'mostly tables' FROM extraction_log WHERE table_share > 0.5
  UNION ALL SELECT source_file, 4, 'formatting', 'info', 'several columns' FROM extraction_log WHERE multi_column_detected
  UNION ALL SELECT source_file, 5, 'formatting', 'warning', replacement_chars_remaining || ' damaged characters' FROM extraction_log
  WHERE replacement_chars_remaining > 0)"""
_LOGGED = r"""logged AS (
  SELECT source_file, unnest(l) AS summary, generate_subscripts(l, 1) - 1 AS i FROM (
    SELECT source_file, list_filter(list_transform(regexp_split_to_array(warnings, '[|;]'), lambda x: trim(x)), lambda x: x <> '') AS l
    FROM extraction_log WHERE warnings IS NOT NULL))"""
_SCORE = """scored AS (
  SELECT candidate_id, greatest(0, least(100, 100
      - CASE WHEN coalesce(trim(name), '') = '' THEN 15 ELSE 0 END - CASE WHEN coalesce(n_positions, 0) = 0 THEN 40 ELSE 0 END
      - CASE WHEN coalesce(trim(location), '') = '' THEN 10 ELSE 0 END - CASE WHEN approach_confidence = 'low' THEN 5 ELSE 0 END
      - CASE WHEN char_count < 1500 THEN 20 ELSE 0 END - least(25, coalesce(flag_count, 0) * 4))) AS score
  FROM (SELECT DISTINCT candidate_id, name, location, email, n_positions, flag_count, approach_confidence, source_file FROM candidates)
  LEFT JOIN (SELECT source_file, min(char_count) AS char_count FROM extraction_log GROUP BY 1) USING (source_file)),
  banded AS (SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS band FROM scored)"""


def _topic() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(summary), '{p}') THEN '{n}'" for n, p in C.TOPICS) + " END"


ORACLES = {
    "contact_check": f"WITH {_CONTACT} SELECT * FROM contact",
    "extraction_warnings": f"WITH {_EXTRACT} SELECT * EXCLUDE (o) FROM extraction",
    "tenure_split": """
        SELECT candidate_id, 'other' AS category, 'info' AS severity,
               CASE WHEN b = 0 THEN 'no investing years' ELSE 'two years or more outside investing' END AS summary
        FROM (SELECT DISTINCT candidate_id, years_experience AS a, years_investment_experience AS b FROM candidates)
        WHERE b = 0 OR b > 0 AND a - b >= 2.0""",
    "seniority_mismatch": f"""
        WITH t AS (SELECT DISTINCT candidate_id, pos, title FROM positions WHERE is_current),
        b AS (SELECT candidate_id, pos, {_hint_case()} AS hint, {SQL_BAND.format("years_experience")} AS band
              FROM t JOIN (SELECT DISTINCT candidate_id, years_experience FROM candidates) USING (candidate_id)),
        r AS (SELECT *, abs(list_position(['intern', 'junior', 'mid', 'senior', 'portfolio_manager'], hint)
              - list_position(['intern', 'junior', 'mid', 'senior', 'portfolio_manager'], band)) AS apart FROM b)
        SELECT candidate_id, pos, hint, band, apart::BIGINT AS apart FROM r WHERE apart >= 2""",
    "credential_pairs": r"""
        SELECT doc_id, list_contains(f, '86') <> list_contains(f, '87') AS unpaired
        FROM (SELECT doc_id, regexp_extract_all(lower(text), 'series\s*(\d+)', 1) AS f FROM documents WHERE text IS NOT NULL)""",
    "postcode_check": r"""
        WITH r AS (SELECT candidate_id, location, regexp_extract(location, '^\s*([^,0-9]+?),?\s', 1) AS city,
                   regexp_extract(location, '\b(\d{5})\b', 1) AS code FROM (SELECT DISTINCT candidate_id, location FROM candidates)),
        k AS (SELECT * FROM r WHERE code <> '' AND city <> ''),
        p AS (SELECT city, p, row_number() OVER (PARTITION BY city ORDER BY n DESC, p) AS i
              FROM (SELECT city, substr(code, 1, 1) AS p, count(*) AS n FROM k GROUP BY 1, 2))
        SELECT candidate_id, location, city, code FROM k
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.city = k.city AND i <= 1 AND starts_with(code, p.p))""",
    "ambiguous_employers": f"""
        SELECT candidate_id, pos, firm FROM (SELECT DISTINCT candidate_id, pos, firm FROM positions)
        JOIN ({RESOLVE["resolve_firms"]}) ON firm = raw WHERE resolution = 'ambiguous'""",
    "flag_topics": f"""
        WITH {_LOGGED} SELECT source_file, i, {_topic()} AS topic,
          CASE WHEN regexp_matches(lower(summary), 'e-?mail|phone|contact') THEN 'Contact' ELSE 'Detail' END AS heading FROM logged""",
    "flag_order": f"""
        WITH {_CONTACT}, {_EXTRACT}, a AS (
          SELECT candidate_id, 0 AS o, category, severity, summary FROM contact
          UNION ALL SELECT candidate_id, o, category, severity, summary FROM extraction
            JOIN (SELECT DISTINCT candidate_id, source_file FROM candidates) USING (source_file)),
        s AS (SELECT candidate_id, string_agg(summary, ' | ' ORDER BY severity <> 'warning',
              list_position([{quoted(C.PRIORITY)}], category), o) AS ordered FROM a GROUP BY 1)
        SELECT c.candidate_id, coalesce(ordered, '') AS ordered FROM (SELECT DISTINCT candidate_id FROM candidates) c LEFT JOIN s USING (candidate_id)""",
    "flag_triage": f"""
        WITH {_LOGGED}, v(match, note, ord) AS (VALUES {", ".join(f"({quoted([m])}, {quoted([n])}, {i})" for i, (m, n) in enumerate(REVIEWS))}),
        h AS (SELECT source_file, i, summary, string_agg(note, '; ' ORDER BY ord) FILTER (WHERE contains(lower(summary), lower(match))) AS notes
              FROM logged, v GROUP BY 1, 2, 3)
        SELECT source_file, i, summary, CASE WHEN notes IS NOT NULL THEN 'info' ELSE 'warning' END AS severity, coalesce(notes, '') AS notes FROM h""",
    "quality_score": f"WITH {_SCORE} SELECT * FROM banded",
    "quality_bands": f"""
        WITH {_SCORE} SELECT b.band, count(x.band) AS n FROM (VALUES ('high'), ('medium'), ('low')) b(band) LEFT JOIN banded x ON b.band = x.band GROUP BY 1""",
    "record_notes": f"""
        WITH {_EXTRACT}, n AS (SELECT l.source_file, count(e.o) AS flags, count(*) FILTER (WHERE e.severity = 'warning') AS warnings
          FROM extraction_log l LEFT JOIN extraction e USING (source_file) GROUP BY 1)
        SELECT source_file, flags, warnings, concat_ws(', ', CASE WHEN flags > 0 THEN flags || ' flags' END,
               CASE WHEN warnings > 0 THEN warnings || ' warnings' END) AS note FROM n""",
}
