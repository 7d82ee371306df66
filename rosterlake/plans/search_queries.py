"""Queries of facets, keyword search, matching and ranking over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.text import STOP_WORDS, tokens
from rosterlake.operators import facets as P
from rosterlake.operators import matching as M
from rosterlake.operators.pool import upper_rank
from rosterlake.plans.common import SQL_SECTORS, people, quoted, sector_list
from rosterlake.session import table

FACETS = ["approach_family", "market_side", "seniority_band", "sectors"]
CHOSEN = {"approach_family": ["fundamental", "hybrid"], "seniority_band": ["junior", "mid"], "sectors": ["healthcare", "technology"]}
QUESTION = "building company models and comparing similar companies for the desk"
WEIGHTS = {"sector_fit": 0.25, "coverage_depth": 0.08, "investing_share": 0.12}


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people(spark, sf_dir, "approach_family", "market_side", "seniority_band", "sectors", "quality_band", "years_experience")
    return rows.withColumn("sectors", F.coalesce(sector_list(F.col("sectors")), F.array().cast("array<string>")))


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).filter(P.matches(CHOSEN, lists=("sectors",))).select("candidate_id")


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.facet_counts(_pool(spark, sf_dir), FACETS, CHOSEN, lists=("sectors",))


def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.options(_pool(spark, sf_dir), "sectors")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "name", "location", "employers", "software_tools")
    hit = P.keyword([F.col(x) for x in ("name", "location", "employers", "software_tools")], "Capital Part")
    return c.filter(hit).select("candidate_id")


def tenure_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenure between 3 and the pool's ceiling, whose handle means no limit; unknown tenure passes."""
    pool = _pool(spark, sf_dir)
    top = pool.agg(F.ceil(F.max("years_experience")).cast("double").alias("top"))
    return pool.crossJoin(F.broadcast(top)).filter(P.in_range(F.col("years_experience"), 3.0, 60.0, F.col("top"))).select("candidate_id")


def quality_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).filter(P.at_least(F.col("quality_band"), ["low", "medium", "high"], "medium")).select("candidate_id", "quality_band")


def coverage_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of a document that has a number and speaks of coverage."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\.\s+|\n").alias("s"))
    quote = F.get(F.filter("s", lambda x: F.lower(x).rlike(r"\bcover(age|ing|s)?\b") & x.rlike(r"\b\d+\b")), F.lit(0))
    return d.select("doc_id", quote.alias("quote")).filter("quote is not null")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lang = 'en' and text is not null").select("doc_id", "candidate_id", "requisition_id", "text")
    return M.sentence_table(d, ["doc_id", "candidate_id", "requisition_id"], "text")


def ask_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents whose best sentence answers the question best."""
    s = _sentences(spark, sf_dir)
    q = [F.lit(QUESTION)]
    scored = s.withColumn("score", M.similarity(tokens(q[0]), M.concepts_in(q[0]), F.col("words"), F.col("concepts"))).filter("score > 0.05")
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "sentence")).alias("b"))
    return best.select("doc_id", "b.score", "b.sentence").orderBy(F.desc("score"), "doc_id").limit(5)


def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(M.concepts_in(F.col("text"))).alias("concept"))
    return d


def requirement_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document written for a requisition, how well its best sentence meets the requisition's summary."""
    r = table(spark, sf_dir, "requisitions").filter("summary is not null").select(
        "requisition_id", tokens(F.col("summary")).alias("req_words"), M.concepts_in(F.col("summary")).alias("req_concepts")
    )
    return M.best_sentence(r, _sentences(spark, sf_dir), ["requisition_id"], ["requisition_id"], ["doc_id"])


def _parts() -> dict[str, tuple[Column, Column]]:
    asks = F.size("sectors_any") > 0
    fit = F.size(F.array_intersect("sectors_any", "sectors")) / F.nullif(F.size("sectors_any"), F.lit(0))
    share = F.try_divide("years_investment_experience", "years_experience")
    return {
        "sector_fit": (fit, F.when(asks, WEIGHTS["sector_fit"])),
        "coverage_depth": (M.depth(F.col("stocks_covered"), F.col("coverage_benchmark")), F.when(F.coalesce("coverage_benchmark", F.lit(40)) > 0, WEIGHTS["coverage_depth"])),
        "investing_share": (share, F.when(F.col("years_experience").isNotNull(), WEIGHTS["investing_share"])),
    }


def _criteria() -> list[Column]:
    region = F.trim("region")
    years = F.col("years_investment_experience")
    return [
        M.criterion(F.size("regions") > 0, "region", F.array_contains("regions", region), region),
        M.criterion(F.size("sectors_any") > 0, "sector", F.arrays_overlap("sectors_any", "sectors"), F.array_join("sectors", ", ")),
        M.criterion(
            F.col("min_years").isNotNull() | F.col("max_years").isNotNull(), "years",
            years.between(F.coalesce("min_years", F.lit(0.0)), F.coalesce("max_years", F.lit(99.0))), years,
        ),
    ]


def _meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against the list of requisitions, a stated set of queries against all rows."""
    c = people(spark, sf_dir, "region", "sectors", "years_experience", "years_investment_experience", "stocks_covered")
    c = c.withColumn("sectors", F.coalesce(sector_list(F.col("sectors")), F.array().cast("array<string>")))
    r = table(spark, sf_dir, "requisitions").select("requisition_id", "regions", "sectors_any", "min_years", "max_years", "coverage_benchmark")
    return c.crossJoin(F.broadcast(r))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.grouped(_meet(spark, sf_dir), _criteria(), M.weighted(list(_parts().values())), ["requisition_id", "candidate_id"], "requisition_id")


def match_exact_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


def match_gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _results(spark, sf_dir).filter("result = 'near'")
    return near.groupBy("requisition_id", "gap").agg(F.count("*").alias("n"))


def match_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every criterion, counted per requisition."""
    long = M.evaluate(_meet(spark, sf_dir), _criteria(), ["requisition_id", "candidate_id"])
    return long.groupBy("requisition_id", "criterion", "passed").agg(F.count("*").alias("n"))


def score_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per requisition and number of parts that count: how many candidates, and the share of the configured weight."""
    active = sum((F.when(F.coalesce(w, F.lit(0.0)) > 0, 1).otherwise(0) for _, w in _parts().values()), F.lit(0))
    weight = sum((F.coalesce(w, F.lit(0.0)) for _, w in _parts().values()), F.lit(0.0)) / sum(WEIGHTS.values())
    rows = _meet(spark, sf_dir).select("requisition_id", active.alias("active"), (weight < 0.6).alias("thin"))
    return rows.groupBy("requisition_id", "active", "thin").agg(F.count("*").alias("n"))


def strongest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For exact results the two parts with the largest score times weight, of those scoring half or more."""
    pairs = _meet(spark, sf_dir)
    exact = F.size(F.filter(F.array_compact(F.array(*_criteria())), lambda c: ~c["passed"])) == 0
    parts = [F.when((w > 0) & (s >= 0.5), F.struct((-(s * w)).alias("k"), F.lit(n).alias("name"))) for n, (s, w) in _parts().items()]
    top = F.slice(F.array_sort(F.array_compact(F.array(*parts))), 1, 2)
    return pairs.filter(exact).select("requisition_id", "candidate_id", F.array_join(F.transform(top, lambda x: x["name"]), ", ").alias("signals"))


def skills_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(w) for w in ("python", "excel", "bloomberg terminal", "sql")])
    c = people(spark, sf_dir, "software_tools")
    have = F.filter(F.transform(F.split(F.lower("software_tools"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return c.select("candidate_id", M.overlap_share(wanted, have).alias("share"))


def component_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the score of the two best exact results of every requisition side by side."""
    best = _results(spark, sf_dir).filter("result = 'exact' and rank <= 2").select("requisition_id", "candidate_id", "rank")
    rows = _meet(spark, sf_dir).join(best, ["requisition_id", "candidate_id"])
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.coalesce(s, F.lit(0.0)).alias("score")) for n, (s, _) in _parts().items()])
    long = rows.select("requisition_id", "rank", F.inline(parts))
    return long.groupBy("requisition_id", "part").pivot("rank", [1, 2]).agg(F.max("score")).withColumnsRenamed({"1": "first", "2": "second"})


def quality_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact results with better quality bands first, else in their order."""
    from pyspark.sql import Window

    q = F.coalesce(F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("quality_band")), F.lit(0))
    rows = _results(spark, sf_dir).filter("result = 'exact'").join(people(spark, sf_dir, "quality_band"), "candidate_id")
    order = Window.partitionBy("requisition_id").orderBy(F.when(q == 0, 9).otherwise(q), "rank")
    return rows.select("requisition_id", "candidate_id", F.row_number().over(order).alias("place"))


def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's columns as (label, value) rows."""
    cols = ["name", "location", "approach", "market_side", "seniority_band", "quality_band"]
    c = people(spark, sf_dir, *cols)
    return c.unpivot("candidate_id", cols, "label", "value").filter("value is not null and trim(value) <> ''")


def requisition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near results of every requisition, also of those without any."""
    r = table(spark, sf_dir, "requisitions").select("requisition_id")
    got = _results(spark, sf_dir).groupBy("requisition_id").agg(
        F.count_if(F.col("result") == "exact").alias("exact"), F.count_if(F.col("result") == "near").alias("near")
    )
    return r.join(got, "requisition_id", "left").fillna(0, ["exact", "near"])


def coverage_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_rank(people(spark, sf_dir, "stocks_covered"), "stocks_covered", 0.75)


QUERIES = {
    f.__name__: f
    for f in (
        facet_filter, facet_counts, facet_options, keyword_search, tenure_range, quality_at_least, coverage_quotes, ask_topk, concept_tags,
        requirement_fit, match_exact_near, match_gap_counts, match_criteria, score_basis, strongest_signals, skills_overlap,
        component_compare, quality_rerank, record_summary, requisition_coverage, coverage_quartile,
    )
}

_POOL = f"""pool AS (SELECT candidate_id, approach_family, market_side, seniority_band, quality_band, years_experience,
    coalesce({SQL_SECTORS.format("sectors")}, []) AS sectors FROM (SELECT DISTINCT candidate_id, approach_family, market_side, seniority_band,
    sectors, quality_band, years_experience FROM candidates))"""
_SEL = {
    "approach_family": "approach_family IN ('fundamental', 'hybrid')",
    "seniority_band": "seniority_band IN ('junior', 'mid')",
    "sectors": "list_has_any(sectors, ['healthcare', 'technology'])",
}
_STOP = quoted(STOP_WORDS)


def _tok(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9+#]{{2,}}')), lambda x: x NOT IN ({_STOP}))"


def _con(c: str) -> str:
    whens = ", ".join(f"CASE WHEN regexp_matches(lower({c}), '{M._pattern(p)}') THEN '{n}' END" for n, p in M.CONCEPTS.items())
    return f"list_filter([{whens}], lambda x: x IS NOT NULL)"


def _sim(rw: str, rc: str, w: str, c: str) -> str:
    lex = f"len(list_intersect({rw}, {w}))::DOUBLE / len({rw})"
    con = f"CASE WHEN len({rc}) > 0 THEN len(list_intersect({rc}, {c}))::DOUBLE / len({rc}) ELSE 0.0::DOUBLE END"
    return f"""CASE WHEN len({rw}) > 0 AND len({w}) > 0 THEN least(1.0::DOUBLE, 0.45::DOUBLE * ({lex}) + 0.75::DOUBLE * ({con})) *
      CASE WHEN len({w}) < 6 THEN 0.55::DOUBLE + 0.075::DOUBLE * len({w}) ELSE 1.0::DOUBLE END END"""


_SENT = rf"""sent0 AS (SELECT doc_id, candidate_id, requisition_id, list_filter(list_transform(regexp_split_to_array(
      regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n'), lambda x: trim(x)), lambda x: length(x) > 3) AS l
    FROM documents WHERE lang = 'en' AND text IS NOT NULL),
  sent1 AS (SELECT doc_id, candidate_id, requisition_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS ord FROM sent0),
  sent AS (SELECT *, {_tok("sentence")} AS words, {_con("sentence")} AS concepts FROM sent1)"""
_MEET = f"""cand AS (SELECT candidate_id, region, coalesce({SQL_SECTORS.format("sectors")}, []) AS sectors, years_experience AS ye,
    years_investment_experience AS yi, stocks_covered FROM (SELECT DISTINCT candidate_id, region, sectors, years_experience,
    years_investment_experience, stocks_covered FROM candidates)),
  meet AS (SELECT *, CASE WHEN len(regions) > 0 THEN coalesce(list_contains(regions, trim(region)), false) END AS c_region,
    CASE WHEN len(sectors_any) > 0 THEN list_has_any(sectors_any, sectors) END AS c_sector,
    CASE WHEN min_years IS NOT NULL OR max_years IS NOT NULL THEN coalesce(yi BETWEEN coalesce(min_years, 0) AND coalesce(max_years, 99), false) END AS c_years,
    len(list_intersect(sectors_any, sectors))::DOUBLE / nullif(len(sectors_any), 0) AS s1, CASE WHEN len(sectors_any) > 0 THEN 0.25::DOUBLE END AS w1,
    least(1.0::DOUBLE, coalesce(stocks_covered, 0)::DOUBLE / nullif(coalesce(coverage_benchmark, 40), 0)) AS s2,
    CASE WHEN coalesce(coverage_benchmark, 40) > 0 THEN 0.08::DOUBLE END AS w2,
    CASE WHEN ye <> 0 THEN yi / ye END AS s3, CASE WHEN ye IS NOT NULL THEN 0.12::DOUBLE END AS w3
    FROM cand, requisitions),
  scored AS (SELECT *, (c_region IS FALSE)::INT + (c_sector IS FALSE)::INT + (c_years IS FALSE)::INT AS failed,
    coalesce((coalesce(s1 * w1, 0) + coalesce(s2 * w2, 0) + coalesce(s3 * w3, 0)) / nullif(coalesce(w1, 0) + coalesce(w2, 0) + coalesce(w3, 0), 0), 0) AS score
    FROM meet),
  result AS (SELECT requisition_id, candidate_id, CASE WHEN failed = 0 THEN 'exact' ELSE 'near' END AS result,
    CASE WHEN c_region IS FALSE THEN 'region' WHEN c_sector IS FALSE THEN 'sector' WHEN c_years IS FALSE THEN 'years' END AS gap, score,
    row_number() OVER (PARTITION BY requisition_id, failed ORDER BY score DESC, candidate_id) AS rank FROM scored WHERE failed <= 1)"""


def _facet(f: str) -> str:
    others = " AND ".join(c for k, c in _SEL.items() if k != f)
    value = "unnest(sectors)" if f == "sectors" else f
    return f"SELECT '{f}' AS facet, {value} AS value FROM pool WHERE coalesce({others}, false)"


ORACLES = {
    "facet_filter": f"WITH {_POOL} SELECT candidate_id FROM pool WHERE {' AND '.join(_SEL.values())}",
    "facet_counts": f"""
        WITH {_POOL} SELECT facet, value, count(*) AS n FROM ({" UNION ALL ".join(_facet(f) for f in FACETS)})
        WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2""",
    "facet_options": f"WITH {_POOL} SELECT DISTINCT unnest(sectors) AS value FROM pool",
    "keyword_search": """
        SELECT candidate_id FROM (SELECT DISTINCT candidate_id, name, location, employers, software_tools FROM candidates)
        WHERE contains(lower(concat_ws(' ', name, location, employers, software_tools)), 'capital part')""",
    "tenure_range": f"""
        WITH {_POOL} SELECT candidate_id FROM pool WHERE years_experience IS NULL OR years_experience >= 3
          AND (years_experience <= 60 OR 60 >= (SELECT ceil(max(years_experience)) FROM pool))""",
    "quality_at_least": f"WITH {_POOL} SELECT candidate_id, quality_band FROM pool WHERE quality_band IN ('medium', 'high')",
    "coverage_quotes": r"""
        SELECT doc_id, q[1] AS quote FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\.\s+|\n'),
          lambda x: regexp_matches(lower(x), '\bcover(age|ing|s)?\b') AND regexp_matches(x, '\b\d+\b')) AS q FROM documents) WHERE len(q) > 0""",
    "ask_topk": f"""
        WITH {_SENT}, q AS (SELECT {_tok(quoted([QUESTION]))} AS rw, {_con(quoted([QUESTION]))} AS rc),
        s AS (SELECT doc_id, ord, sentence, {_sim("rw", "rc", "words", "concepts")} AS score FROM sent, q),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM s WHERE score > 0.05)
        SELECT doc_id, score, sentence FROM b WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 5""",
    "concept_tags": f"SELECT doc_id, unnest({_con('text')}) AS concept FROM documents WHERE text IS NOT NULL",
    "requirement_fit": f"""
        WITH {_SENT}, q AS (SELECT requisition_id, {_tok("summary")} AS rw, {_con("summary")} AS rc FROM requisitions WHERE summary IS NOT NULL),
        s AS (SELECT requisition_id, doc_id, ord, sentence, {_sim("rw", "rc", "words", "concepts")} AS score FROM sent JOIN q USING (requisition_id)),
        b AS (SELECT *, row_number() OVER (PARTITION BY requisition_id, doc_id ORDER BY score DESC, ord) AS r FROM s WHERE score > 0)
        SELECT requisition_id, doc_id, score, sentence FROM b WHERE r = 1""",
    "match_exact_near": f"WITH {_MEET} SELECT * FROM result",
    "match_gap_counts": f"WITH {_MEET} SELECT requisition_id, gap, count(*) AS n FROM result WHERE result = 'near' GROUP BY 1, 2",
    "match_criteria": f"""
        WITH {_MEET} SELECT requisition_id, criterion, passed, count(*) AS n FROM (
          SELECT requisition_id, 'region' AS criterion, c_region AS passed FROM meet UNION ALL SELECT requisition_id, 'sector', c_sector FROM meet
          UNION ALL SELECT requisition_id, 'years', c_years FROM meet) WHERE passed IS NOT NULL GROUP BY 1, 2, 3""",
    "score_basis": f"""
        WITH {_MEET} SELECT requisition_id, (w1 IS NOT NULL)::INT + (w2 IS NOT NULL)::INT + (w3 IS NOT NULL)::INT AS active,
          (coalesce(w1, 0) + coalesce(w2, 0) + coalesce(w3, 0)) / 0.45 < 0.6 AS thin, count(*) AS n FROM meet GROUP BY ALL""",
    "strongest_signals": f"""
        WITH {_MEET}, e AS (SELECT * FROM scored WHERE failed = 0),
        p AS (SELECT requisition_id, candidate_id, 'sector_fit' AS name, s1 AS s, w1 AS w FROM e
              UNION ALL SELECT requisition_id, candidate_id, 'coverage_depth', s2, w2 FROM e
              UNION ALL SELECT requisition_id, candidate_id, 'investing_share', s3, w3 FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY requisition_id, candidate_id ORDER BY s * w DESC, name) AS r FROM p WHERE w > 0 AND s >= 0.5)
        SELECT e.requisition_id, e.candidate_id, coalesce(string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 2), '') AS signals
        FROM e LEFT JOIN r USING (requisition_id, candidate_id) GROUP BY 1, 2""",
    "skills_overlap": """
        WITH c AS (SELECT candidate_id, list_filter(list_transform(string_split(lower(software_tools), ';'), lambda x: trim(x)), lambda x: x <> '') AS h
          FROM (SELECT DISTINCT candidate_id, software_tools FROM candidates))
        SELECT candidate_id, len(list_filter(['python', 'excel', 'bloomberg terminal', 'sql'],
          lambda w: len(list_filter(coalesce(h, []), lambda x: contains(x, w) OR contains(w, x))) > 0)) / 4 AS share FROM c""",
    "component_compare": f"""
        WITH {_MEET}, b AS (SELECT m.*, r.rank FROM meet m JOIN result r USING (requisition_id, candidate_id) WHERE r.result = 'exact' AND rank <= 2),
        p AS (SELECT requisition_id, rank, 'sector_fit' AS part, coalesce(s1, 0) AS s FROM b
              UNION ALL SELECT requisition_id, rank, 'coverage_depth', coalesce(s2, 0) FROM b
              UNION ALL SELECT requisition_id, rank, 'investing_share', coalesce(s3, 0) FROM b)
        SELECT requisition_id, part, max(s) FILTER (WHERE rank = 1) AS first, max(s) FILTER (WHERE rank = 2) AS second FROM p GROUP BY 1, 2""",
    "quality_rerank": f"""
        WITH {_MEET} SELECT requisition_id, candidate_id, row_number() OVER (PARTITION BY requisition_id
          ORDER BY coalesce(list_position(['high', 'medium', 'low'], quality_band), 9), rank) AS place
        FROM result JOIN (SELECT DISTINCT candidate_id, quality_band FROM candidates) USING (candidate_id) WHERE result = 'exact'""",
    "record_summary": """
        SELECT candidate_id, label, value FROM (SELECT DISTINCT candidate_id, name, location, approach, market_side, seniority_band, quality_band FROM candidates)
        UNPIVOT (value FOR label IN (name, location, approach, market_side, seniority_band, quality_band)) WHERE trim(value) <> ''""",
    "requisition_coverage": f"""
        WITH {_MEET} SELECT q.requisition_id, count(*) FILTER (WHERE result = 'exact') AS exact, count(*) FILTER (WHERE result = 'near') AS near
        FROM requisitions q LEFT JOIN result r USING (requisition_id) GROUP BY 1""",
    "coverage_quartile": """
        WITH s AS (SELECT stocks_covered AS v, row_number() OVER (ORDER BY stocks_covered) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT candidate_id, stocks_covered FROM candidates) WHERE stocks_covered IS NOT NULL)
        SELECT v AS value FROM s WHERE i = floor(n * 0.75)""",
}
