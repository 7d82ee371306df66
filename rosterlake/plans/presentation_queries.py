"""Queries of the rows and texts for readers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import checks as C
from rosterlake.operators import presentation as V
from rosterlake.operators.resolve import resolve_names
from rosterlake.plans.check_queries import _CONTACT
from rosterlake.plans.common import people, quoted, roles
from rosterlake.plans.resolve_queries import ORACLES as RESOLVE
from rosterlake.plans.search_queries import _MEET, _meet, _parts, _results
from rosterlake.session import table

HELP = {"sector_fit": "Share of the wanted sectors.", "coverage_depth": "Names covered against the benchmark.", "years": "Investing years."}


def score_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the score of every exact result."""
    exact = _results(spark, sf_dir).filter("result = 'exact'").select("requisition_id", "candidate_id")
    rows = _meet(spark, sf_dir).join(exact, ["requisition_id", "candidate_id"])
    return V.ledger(rows, ["requisition_id", "candidate_id"], _parts())


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every exact and near result."""
    c = people(spark, sf_dir, "name", "location", "seniority_band")
    rows = _results(spark, sf_dir).join(c, "candidate_id")
    return rows.select("requisition_id", "candidate_id", "result", V.result_line([F.col("name"), F.col("location"), F.col("seniority_band")], F.col("gap")).alias("line"))


def outreach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for every exact result, quoting the requisition's summary."""
    exact = _results(spark, sf_dir).filter("result = 'exact'")
    rows = exact.join(people(spark, sf_dir, "name", "email"), "candidate_id").join(table(spark, sf_dir, "requisitions").select("requisition_id", "title", "summary"), "requisition_id")
    text = V.letter(F.col("name"), F.col("email"), F.concat(F.lit("exact match for "), F.col("title")), F.lit(""), F.col("summary"))
    return rows.select("requisition_id", "candidate_id", F.md5(text).alias("text_md5"))


def position_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roles(spark, sf_dir, "firm", "duration_months")
    links = resolve_names(p, table(spark, sf_dir, "firms")).filter("canonical is not null").withColumn("ord", F.lit(0))
    rows = V.linked_positions(p, links.select("raw", "canonical", "ord"))
    dates = V.shown_dates(F.col("start_date"), F.col("end_date"), F.col("is_current"), F.col("duration_months"))
    return rows.select("candidate_id", "pos", "firm", "canonical", dates.alias("dates"))


def flag_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "email", "location")
    flags = V.stamp_flags(C.contact_flags(F.col("email")), "computed", F.coalesce(F.trim("location"), F.lit("")) != "")
    return c.select("candidate_id", F.inline(flags))


def help_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in ["sector_fit", "coverage_depth", "years", "other"]], "name string")
    return V.help_text(keys, HELP, "name")


QUERIES = {f.__name__: f for f in (score_ledger, result_lines, outreach_text, position_links, flag_stamp, help_texts)}
ORACLES = {
    "score_ledger": f"""
        WITH {_MEET}, b AS (SELECT m.* FROM meet m JOIN result r USING (requisition_id, candidate_id) WHERE r.result = 'exact' ),
        p AS (SELECT requisition_id, candidate_id, 'sector_fit' AS part, s1 AS score, coalesce(w1, 0) AS weight FROM b
          UNION ALL SELECT requisition_id, candidate_id, 'coverage_depth', s2, coalesce(w2, 0) FROM b
          UNION ALL SELECT requisition_id, candidate_id, 'investing_share', s3, coalesce(w3, 0) FROM b)
        SELECT *, weight > 0 AS active, row_number() OVER (PARTITION BY requisition_id, candidate_id ORDER BY weight > 0 DESC, weight DESC, part) AS place FROM p""",
    "result_lines": f"""
        WITH {_MEET}, c AS (SELECT DISTINCT candidate_id, name, location, seniority_band FROM candidates),
        l AS (SELECT requisition_id, candidate_id, result, gap, concat_ws(' · ', nullif(trim(name, ' '), ''), nullif(trim(location, ' '), ''), nullif(trim(seniority_band, ' '), '')) AS k
              FROM result JOIN c USING (candidate_id))
        SELECT requisition_id, candidate_id, result, CASE WHEN gap IS NOT NULL THEN k || ' — misses ' || gap ELSE k END AS line FROM l""",
    "outreach_text": f"""
        WITH {_MEET}, c AS (SELECT DISTINCT candidate_id, name, email FROM candidates)
        SELECT r.requisition_id, r.candidate_id, md5(concat_ws(chr(10), name, email, 'exact match for ' || q.title,
          CASE WHEN length(q.summary) > 180 THEN substr(q.summary, 1, 180) || '…' ELSE q.summary END)) AS text_md5
        FROM result r JOIN c USING (candidate_id) JOIN requisitions q ON q.requisition_id = r.requisition_id WHERE r.result = 'exact'""",
    "position_links": f"""
        WITH r AS ({RESOLVE["resolve_firms"]}), p AS (SELECT DISTINCT candidate_id, pos, firm, start_date, end_date, is_current, duration_months FROM positions)
        SELECT candidate_id, pos, firm, canonical, CASE WHEN start_date IS NOT NULL THEN start_date || ' to ' ||
          CASE WHEN coalesce(is_current, false) THEN 'present' ELSE coalesce(end_date, '?') END
          WHEN duration_months IS NOT NULL THEN duration_months || ' months' END AS dates FROM p LEFT JOIN r ON firm = raw""",
    "flag_stamp": f"WITH {_CONTACT} SELECT *, 'computed' AS source FROM contact",
    "help_texts": f"""
        SELECT name, coalesce(help, '') AS help FROM (VALUES ('sector_fit'), ('coverage_depth'), ('years'), ('other')) k(name)
        LEFT JOIN (VALUES {", ".join(f"({quoted([k])}, {quoted([v])})" for k, v in HELP.items())}) h(key, help) ON name = key""",
}
