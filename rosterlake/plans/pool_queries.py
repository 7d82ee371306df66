"""Queries of the pool aggregates, layout, exports and event windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import layout as L
from rosterlake.operators import pool as A
from rosterlake.operators.resolve import resolve_fully
from rosterlake.plans.common import SQL_ROLES, SQL_SECTORS, people, roles, sector_list
from rosterlake.plans.search_queries import _MEET, _results
from rosterlake.sources.export import cache_misses, flat_record
from rosterlake.streaming.events import session_windows, sliding_counts, tumbling_counts
from rosterlake.session import table


def group_sector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "seniority_band", "sectors").withColumn("sectors", sector_list(F.col("sectors")))
    return A.matrix(c, "seniority_band", "sectors", "candidate_id")


def tenure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "years_experience", "years_investment_experience").filter("years_experience is not null")
    return c.select("candidate_id", "years_experience", F.coalesce("years_investment_experience", F.lit(0.0)).alias("investing"))


def top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = people(spark, sf_dir, "software_tools").select("candidate_id", F.explode(F.split("software_tools", ";")).alias("tool"))
    return A.top_values(tools.withColumn("tool", F.trim("tool")).distinct(), "tool", "candidate_id", 9)


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every position whose firm is resolved as a whole."""
    firms = table(spark, sf_dir, "firms")
    p = roles(spark, sf_dir, "firm")
    m = p.join(resolve_fully(p, firms).filter("resolution in ('exact', 'alias', 'fuzzy')"), F.col("firm") == F.col("raw"))
    return A.network_edges(m.select(F.col("candidate_id").alias("person"), "canonical"), firms)


def network_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "firms").select(F.col("firm_type").alias("layer"), F.col("canonical").alias("node"))
    return A.layout(n, "layer", "node")


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upper_rank(people(spark, sf_dir, "quality_score"), "quality_score")


def rarity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "approach_family", "has_buy_side", "has_sell_side", "in_junior_range")
    traits = [
        ("hybrid", F.col("approach_family") == "hybrid"),
        ("systematic", F.col("approach_family") == "systematic_quant"),
        ("both sides", F.col("has_buy_side") & F.col("has_sell_side")),
        ("junior", F.col("in_junior_range")),
    ]
    return A.rarity_tags(c, traits, 0.4, 3, "candidate_id")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "screening_labels").select("requisition_id", "candidate_id", "label").distinct()
    exact = _results(spark, sf_dir).select("requisition_id", "candidate_id", "result", "gap")
    return labels.join(exact, ["requisition_id", "candidate_id"], "left").withColumn("hit", F.coalesce(F.col("result") == "exact", F.lit(False)))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(_judged(spark, sf_dir), "requisition_id", "label", "hit")


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the results contradict, with the criterion a near result missed."""
    j = _judged(spark, sf_dir).filter("label = 'yes' and not hit or label = 'no' and hit")
    reason = F.when(F.col("hit"), "accepted").otherwise(F.coalesce("gap", F.lit("several")))
    return j.select("requisition_id", "candidate_id", "label", reason.alias("reason"))


def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the extraction runs by file type, with a total."""
    return table(spark, sf_dir, "extraction_log").rollup("file_type").agg(
        F.count("*").alias("files"),
        F.sum("char_count").alias("chars"),
        F.count_if(F.col("char_count") < 1000).alias("thin"),
        F.sum("ligature_repairs").alias("repairs"),
        F.count_if(F.col("multi_column_detected")).alias("columns"),
    )


def metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and kind of figure: how many and the first, cut after 24 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("found"))
            for k, p in (("percent", r"(\d+(?:\.\d+)? percent)"), ("years", r"(\d+ years)"), ("year", r"\b((?:19|20)\d\d)\b"))
        ]
    )
    rows = d.select("doc_id", F.inline(kinds)).filter(F.size("found") > 0)
    first = F.get("found", F.lit(0))
    return rows.select("doc_id", "kind", F.size("found").alias("n"), F.when(F.length(first) > 26, F.concat(F.substring(first, 1, 24), F.lit("…"))).otherwise(first).alias("first"))


def merged_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and sectors of a candidate as one list, the first of equal ones, in order."""
    c = people(spark, sf_dir, "approach_keywords", "sectors")
    parts = [F.coalesce(F.split(F.lower(x), ";"), F.array().cast("array<string>")) for x in ("approach_keywords", "sectors")]
    both = F.transform(F.concat(*parts), lambda x: F.trim(x))
    return c.select("candidate_id", F.array_join(F.array_distinct(F.filter(both, lambda x: x != "")), "|").alias("keywords"))


def words_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with places, as a page reader gives them: lines of the document, a second column for every other block."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    lines = d.select("doc_id", F.posexplode("l").alias("row", "line"))
    words = lines.select("doc_id", "row", F.posexplode(F.split("line", " ")).alias("i", "text")).filter("text <> ''")
    x0 = F.when(F.col("row") % 2 == 1, 320.0).otherwise(20.0) + F.col("i") * 18.0
    return words.select("doc_id", F.lit(0).alias("page"), x0.alias("x0"), (F.floor(F.col("row") / 2) * 12.0 + F.col("i") % 2).alias("top"), "text")


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_lines(words_table(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "line", F.md5("text").alias("text_md5"), F.col("n_words"))


def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detect_columns(words_table(spark, sf_dir), ["doc_id", "page"], 600.0)


def column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.render_columns(words_table(spark, sf_dir), ["doc_id", "page"], 300.0).select("doc_id", "column", "n_words", F.md5("text").alias("text_md5"))


def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records (a candidate with its positions) flattened to delimited columns."""
    p = roles(spark, sf_dir, "firm", "title").groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "firm", "title", "start_date", "end_date"))).alias("positions")
    )
    return flat_record(people(spark, sf_dir, "name", "seniority_band").join(p, "candidate_id", "left"))


def cache_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content key is not among those of the documents received earlier in the data (the cache)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "received_at")
    cached = d.filter("received_at < timestamp'2025-01-01'")
    return cache_misses(d.filter("received_at >= timestamp'2025-01-01'"), cached, "text", "v1").select("doc_id", "cache_key")


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events"), "1 hour")


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_counts(table(spark, sf_dir, "events"), "2 hours", "1 hour")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_windows(table(spark, sf_dir, "events"), "30 minutes")


QUERIES = {
    f.__name__: f
    for f in (
        group_sector_matrix, tenure_pairs, top_tools, network_edges, network_layout, upper_median, rarity_tags, confusion_matrix,
        disagreements, extraction_stats, metric_counts, merged_keywords, line_groups, column_split, column_text, flat_export,
        cache_anti_join, event_tumbling, event_sliding, event_sessions,
    )
}

_WORDS = """words AS (
  SELECT doc_id, 0 AS page, CASE WHEN row % 2 = 1 THEN 320.0::DOUBLE ELSE 20.0::DOUBLE END + i * 18.0::DOUBLE AS x0,
         (row // 2) * 12.0::DOUBLE + i % 2 AS top, text
  FROM (SELECT doc_id, row, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i FROM (
    SELECT doc_id, row, string_split(line, ' ') AS w FROM (
      SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS row FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))))
  WHERE text <> '')"""
_JUDGED = f"""{_MEET}, judged AS (
  SELECT l.requisition_id, l.candidate_id, l.label, coalesce(r.result = 'exact', false) AS hit, r.gap
  FROM (SELECT DISTINCT requisition_id, candidate_id, label FROM screening_labels) l LEFT JOIN result r USING (requisition_id, candidate_id))"""
ORACLES = {
    "group_sector_matrix": f"""
        WITH o AS (SELECT candidate_id, seniority_band AS grp, {SQL_SECTORS.format("sectors")} AS v
                   FROM (SELECT DISTINCT candidate_id, seniority_band, sectors FROM candidates)),
        e AS (SELECT grp, unnest(v) AS value FROM o)
        SELECT grp, value, count(*) AS n FROM e WHERE coalesce(trim(grp), '') <> '' GROUP BY 1, 2
        UNION ALL SELECT NULL, value, count(*) FROM e GROUP BY value
        UNION ALL SELECT grp, NULL, count(*) FROM o WHERE coalesce(trim(grp), '') <> '' GROUP BY grp""",
    "tenure_pairs": """
        SELECT DISTINCT candidate_id, years_experience, coalesce(years_investment_experience, 0) AS investing FROM candidates WHERE years_experience IS NOT NULL""",
    "top_tools": """
        WITH t AS (SELECT DISTINCT candidate_id, trim(tool) AS tool FROM (SELECT candidate_id, unnest(string_split(software_tools, ';')) AS tool FROM candidates))
        SELECT tool, count(*) AS n FROM t WHERE tool <> '' GROUP BY 1 ORDER BY n DESC, min(candidate_id), tool LIMIT 9""",
    "network_layout": """
        SELECT firm_type AS layer, canonical AS node, (row_number() OVER (PARTITION BY firm_type ORDER BY canonical) - 0.5) / count(*) OVER (PARTITION BY firm_type) AS y
        FROM firms""",
    "upper_median": """
        WITH s AS (SELECT quality_score AS v, row_number() OVER (ORDER BY quality_score) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT candidate_id, quality_score FROM candidates) WHERE quality_score IS NOT NULL)
        SELECT v AS value FROM s WHERE i = n // 2""",
    "rarity_tags": """
        WITH m AS (SELECT candidate_id, coalesce(approach_family = 'hybrid', false) AS a, coalesce(approach_family = 'systematic_quant', false) AS b,
            coalesce(has_buy_side AND has_sell_side, false) AS c, coalesce(in_junior_range, false) AS d
          FROM (SELECT DISTINCT candidate_id, approach_family, has_buy_side, has_sell_side, in_junior_range FROM candidates)),
        s AS (SELECT avg(a::INT) AS a, avg(b::INT) AS b, avg(c::INT) AS c, avg(d::INT) AS d FROM m)
        SELECT candidate_id, array_to_string(list_filter([CASE WHEN m.a AND s.a < 0.4 THEN 'hybrid' END, CASE WHEN m.b AND s.b < 0.4 THEN 'systematic' END,
          CASE WHEN m.c AND s.c < 0.4 THEN 'both sides' END, CASE WHEN m.d AND s.d < 0.4 THEN 'junior' END], lambda x: x IS NOT NULL)[1:3], '; ') AS tags FROM m, s""",
    "confusion_matrix": f"""
        WITH {_JUDGED}, c AS (SELECT requisition_id, count(*) FILTER (WHERE label = 'yes' AND hit) AS tp, count(*) FILTER (WHERE label = 'no' AND hit) AS fp,
          count(*) FILTER (WHERE label = 'yes' AND NOT hit) AS fn, count(*) FILTER (WHERE label = 'no' AND NOT hit) AS tn,
          count(*) FILTER (WHERE label = 'borderline') AS borderline FROM judged GROUP BY ROLLUP (requisition_id))
        SELECT *, tp + fp + fn + tn AS judged, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
          (tp + tn) / nullif(tp + fp + fn + tn, 0) AS agreement FROM c""",
    "disagreements": f"""
        WITH {_JUDGED} SELECT requisition_id, candidate_id, label, CASE WHEN hit THEN 'accepted' ELSE coalesce(gap, 'several') END AS reason
        FROM judged WHERE label = 'yes' AND NOT hit OR label = 'no' AND hit""",
    "extraction_stats": """
        SELECT file_type, count(*) AS files, sum(char_count)::BIGINT AS chars, count(*) FILTER (WHERE char_count < 1000) AS thin,
          sum(ligature_repairs)::BIGINT AS repairs, count(*) FILTER (WHERE multi_column_detected) AS columns FROM extraction_log GROUP BY ROLLUP (file_type)""",
    "metric_counts": r"""
        WITH k AS (SELECT doc_id, 'percent' AS kind, regexp_extract_all(text, '(\d+(?:\.\d+)? percent)', 1) AS f FROM documents
          UNION ALL SELECT doc_id, 'years', regexp_extract_all(text, '(\d+ years)', 1) FROM documents
          UNION ALL SELECT doc_id, 'year', regexp_extract_all(text, '\b((?:19|20)\d\d)\b', 1) FROM documents)
        SELECT doc_id, kind, len(f) AS n, CASE WHEN length(f[1]) > 26 THEN substr(f[1], 1, 24) || '…' ELSE f[1] END AS first FROM k WHERE len(f) > 0""",
    "merged_keywords": """
        WITH c AS (SELECT candidate_id, list_filter(list_transform(list_concat(coalesce(string_split(lower(approach_keywords), ';'), []),
            coalesce(string_split(lower(sectors), ';'), [])), lambda x: trim(x)), lambda x: x <> '') AS l
          FROM (SELECT DISTINCT candidate_id, approach_keywords, sectors FROM candidates))
        SELECT candidate_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS keywords FROM c""",
    "line_groups": f"""
        WITH {_WORDS} SELECT doc_id, line, md5(string_agg(text, ' ' ORDER BY x0, text)) AS text_md5, count(*) AS n_words
        FROM (SELECT *, round_even(top / 3.0, 0)::BIGINT AS line FROM words) GROUP BY 1, 2""",
    "column_text": f"""
        WITH {_WORDS}, w AS (SELECT *, round_even(top / 3.0, 0)::BIGINT AS line, CASE WHEN x0 < 300 THEN 0 ELSE 1 END AS col FROM words),
        l AS (SELECT doc_id, page, col, line, string_agg(text, ' ' ORDER BY x0, text) AS t, count(*) AS n FROM w GROUP BY ALL)
        SELECT doc_id, col AS "column", sum(n)::BIGINT AS n_words, md5(string_agg(t, chr(10) ORDER BY line)) AS text_md5 FROM l GROUP BY 1, 2""",
    "flat_export": f"""
        WITH {SQL_ROLES}, p AS (SELECT candidate_id, string_agg(coalesce(firm, '') || ' - ' || coalesce(title, '') || ' [' || coalesce(start_date, '') || '..' ||
            coalesce(end_date, '') || ']', ' | ' ORDER BY pos, firm, title, start_date, end_date) AS positions, count(*) AS n_positions FROM roles GROUP BY 1)
        SELECT c.candidate_id, name, seniority_band, coalesce(positions, '') AS positions, coalesce(n_positions, 0) AS n_positions
        FROM (SELECT DISTINCT candidate_id, name, seniority_band FROM candidates) c LEFT JOIN p USING (candidate_id)""",
    "cache_anti_join": """
        WITH k AS (SELECT doc_id, received_at, sha256(coalesce(text, '') || chr(31) || 'v1')[1:16] AS cache_key FROM documents)
        SELECT doc_id, cache_key FROM k WHERE received_at >= TIMESTAMP '2025-01-01'
          AND cache_key NOT IN (SELECT cache_key FROM k WHERE received_at < TIMESTAMP '2025-01-01')""",
    "event_tumbling": """
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "event_sliding": """
        SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) x(k)
        WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events
                   WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
