"""Queries of the interval operators over the project's positions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import intervals as I
from rosterlake.plans.common import AS_OF, SQL_BAND, SQL_ROLES, SQL_SPANS, people, roles, sql_month
from rosterlake.session import table


def _spans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return I.spans(roles(spark, sf_dir, *columns), AS_OF)


def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month every distinct date text names."""
    p = table(spark, sf_dir, "positions")
    both = p.select(F.col("start_date").alias("raw")).union(p.select("end_date")).filter("raw is not null").distinct()
    from rosterlake.functions.months import month_number

    return both.select("raw", month_number(F.col("raw")).cast("long").alias("month"))


def years_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles(spark, sf_dir, "employment_type", "is_investment_role", "duration_months")
    paid = F.col("employment_type") == "professional"
    career = I.years_of_experience(rows, "candidate_id", AS_OF, paid).withColumnRenamed("years", "career_years")
    own = I.years_of_experience(rows, "candidate_id", AS_OF, paid & F.col("is_investment_role")).withColumnRenamed("years", "investing_years")
    return career.join(own, "candidate_id")


def date_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that end before they start, or start after the day of reading."""
    r = roles(spark, sf_dir)
    kind = F.when(F.col("e") < F.col("s"), "ends before start").when(F.col("s") > AS_OF, "starts in the future")
    return r.select("candidate_id", "pos", kind.alias("anomaly"), I.month_text(F.col("s")).alias("start_month")).filter("anomaly is not null")


def career_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir, "employment_type").filter("employment_type = 'professional'")
    return I.gaps(rows, "candidate_id", 6)


def concurrent_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.concurrent(_spans(spark, sf_dir), "candidate_id", "pos", 2)


def study_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first full-time position that overlaps each academic one by six months or more."""
    rows = _spans(spark, sf_dir, "employment_type").withColumn("id", F.col("pos"))
    study = rows.filter("employment_type = 'academic'").select("candidate_id", "id", "s", "e")
    work = rows.filter("employment_type = 'professional'").select("candidate_id", "id", "s", "e")
    return I.first_overlap(study, work, "candidate_id", 6)


def junior_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "years_investment_experience")
    return c.select("candidate_id", F.col("years_investment_experience").between(1, 5).alias("junior"))


QUERIES = {
    f.__name__: f
    for f in (partial_dates, years_experience, date_anomalies, career_gaps, concurrent_roles, study_overlap, junior_range)
}


def _years(condition: str, name: str) -> str:
    return f"""
      {name}_g AS (SELECT candidate_id, greatest(e - greatest(s, coalesce(max(e) OVER (PARTITION BY candidate_id ORDER BY s, e
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)), 0) AS gain FROM spans WHERE {condition}),
      {name}_m AS (SELECT candidate_id, sum(gain) AS months FROM {name}_g GROUP BY 1),
      {name}_x AS (SELECT candidate_id, sum(duration_months) AS extra FROM roles WHERE s IS NULL AND {condition} GROUP BY 1),
      {name} AS (SELECT k.candidate_id, CASE WHEN months IS NOT NULL OR extra IS NOT NULL OR datable
          THEN round_even((coalesce(months, 0) + coalesce(extra, 0)) / 12, 1) END AS years
        FROM (SELECT candidate_id, bool_or(s IS NOT NULL) AS datable FROM roles GROUP BY 1) k
        LEFT JOIN {name}_m USING (candidate_id) LEFT JOIN {name}_x USING (candidate_id))"""


_PAID = "employment_type = 'professional'"
ORACLES = {
    "partial_dates": f"""
        SELECT DISTINCT raw, ({sql_month("raw")})::BIGINT AS month
        FROM (SELECT start_date AS raw FROM positions UNION SELECT end_date FROM positions) WHERE raw IS NOT NULL""",
    "years_experience": f"""
        WITH {SQL_SPANS}, {_years(_PAID, "a")}, {_years(_PAID + " AND is_investment_role", "b")}
        SELECT a.candidate_id, a.years AS career_years, b.years AS investing_years FROM a JOIN b USING (candidate_id)""",
    "date_anomalies": f"""
        WITH {SQL_ROLES}
        SELECT candidate_id, pos, CASE WHEN e < s THEN 'ends before start' ELSE 'starts in the future' END AS anomaly,
               format('{{:04d}}-{{:02d}}', (s - 1) // 12, (s - 1) % 12 + 1) AS start_month
        FROM roles WHERE e < s OR s > {AS_OF}""",
    "career_gaps": f"""
        WITH {SQL_SPANS}, u AS (SELECT DISTINCT candidate_id, s, e FROM spans WHERE {_PAID}),
        w AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)
        SELECT candidate_id, before AS gap_start, s AS gap_end, s - before AS months FROM w WHERE s - before >= 6""",
    "concurrent_roles": f"""
        WITH {SQL_SPANS}
        SELECT DISTINCT a.candidate_id, a.pos AS first, b.pos AS second, least(a.e, b.e) - greatest(a.s, b.s) AS months
        FROM spans a JOIN spans b ON a.candidate_id = b.candidate_id AND a.pos < b.pos
        WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 2""",
    "study_overlap": f"""
        WITH {SQL_SPANS}, m AS (
          SELECT a.candidate_id, a.pos AS id, b.pos AS other, least(a.e, b.e) - greatest(a.s, b.s) AS months,
                 row_number() OVER (PARTITION BY a.candidate_id, a.pos ORDER BY b.s, b.pos, least(a.e, b.e) - greatest(a.s, b.s)) AS r
          FROM spans a JOIN spans b ON a.candidate_id = b.candidate_id
          WHERE a.employment_type = 'academic' AND b.employment_type = 'professional' AND least(a.e, b.e) - greatest(a.s, b.s) >= 6)
        SELECT candidate_id, id, other, months FROM m WHERE r = 1""",
    "junior_range": """
        SELECT DISTINCT candidate_id, years_investment_experience BETWEEN 1 AND 5 AS junior FROM candidates""",
}
P3_ORACLE = f"""
    WITH {SQL_SPANS}, u AS (SELECT DISTINCT candidate_id, s, e FROM spans),
    w AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e) AS island FROM w),
    p AS (SELECT candidate_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2)
    SELECT candidate_id, 'period' AS span_kind, s::INT AS start_month, e::INT AS end_month FROM p
    UNION ALL
    SELECT candidate_id, 'gap', before::INT, s::INT FROM w WHERE s > before"""
__all__ = ["ORACLES", "P3_ORACLE", "QUERIES", "SQL_BAND"]
