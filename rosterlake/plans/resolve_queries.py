"""Queries of the dictionary joins and resolvers over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import resolve as R
from rosterlake.plans.common import (
    BANDS, BUY_SIDE, PLATFORMS, SELL_SIDE, SQL_BAND, SQL_FOLD, SQL_ROLES, TITLE_HINTS, people, quoted, roles,
)
from rosterlake.session import table

SOFTWARE = [
    ("bloomberg terminal", "Bloomberg"), ("bloomberg", "Bloomberg"), ("bbg", "Bloomberg"), ("factset", "FactSet"),
    ("capital iq", "Capital IQ"), ("capiq", "Capital IQ"), ("ms excel", "Excel"), ("microsoft excel", "Excel"), ("excel", "Excel"),
    ("powerpoint", "PowerPoint"), ("python", "Python"), ("r programming", "R"), ("r", "R"), ("sql", "SQL"), ("vba", "VBA"),
    ("c++", "C++"), ("java", "Java"), ("matlab", "MATLAB"), ("tableau", "Tableau"), ("power bi", "Power BI"),
]
SECTOR_WORDS = [
    ("software", "technology"), ("semiconductors", "technology"), ("bank", "financials"), ("insurance", "financials"),
    ("solar", "energy"), ("mining", "materials"), ("chemicals", "materials"), ("paper", "materials"), ("steel", "materials"),
    ("retail", "consumer"), ("drinks", "consumer"), ("hospital", "healthcare"), ("media", "media_telecom"),
    ("housing", "real_estate"), ("shipping", "industrials"), ("freight", "industrials"), ("credit", "credit"),
]
CREDENTIALS = [
    ("CFA", "Chartered Financial Analyst"), ("FRM", "Financial Risk Manager"), ("CPA", "Certified Public Accountant"),
    ("Series 7", "General Securities Representative"), ("Series 63", "Uniform Securities Agent (State Law)"),
    ("Series 86", "Research Analyst (Analysis)"), ("Series 87", "Research Analyst (Regulatory Administration)"),
]
STATED = ["CFA", "cfa", " FRM ", "Series 7", "series 87 ", "Series 86 (passed)", "CPA - in progress", "MBA", "Six Sigma", ""]


def _pairs(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{names}, ord int")


def firm_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.name_index(table(spark, sf_dir, "firms"))


def resolve_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_names(table(spark, sf_dir, "positions"), table(spark, sf_dir, "firms"))


def resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence-similarity resolution (no SQL has this ratio; tested against plain Python)."""
    return R.fuzzy_resolve(table(spark, sf_dir, "positions"), table(spark, sf_dir, "firms"))


def firm_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lineage(table(spark, sf_dir, "firms"))


def platform_alumni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms among the resolved employers of a candidate and the owners of those, in order of first mention."""
    firms = table(spark, sf_dir, "firms").select("canonical", "firm_type", "parent")
    own = firms.select(F.col("canonical").alias("root"), F.col("canonical").alias("ancestor"), F.lit(0).alias("lvl"))
    line = own.unionByName(R.lineage(firms)).join(firms, F.col("ancestor") == F.col("canonical")).filter(F.col("firm_type").isin(*PLATFORMS))
    line = line.select("root", "lvl", F.coalesce("parent", "ancestor").alias("platform"))
    work = roles(spark, sf_dir, "firm", "employment_type").filter("employment_type = 'professional'")
    links = R.resolve_fully(work, table(spark, sf_dir, "firms")).filter("canonical is not null")
    met = work.join(links, F.col("firm") == F.col("raw")).join(line, F.col("canonical") == F.col("root")).groupBy("candidate_id", "platform").agg(F.min(F.struct("pos", "lvl")).alias("o"))
    return met.groupBy("candidate_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "platform"))), lambda x: x["platform"]), "; ").alias("platforms")
    )


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "canon_values").filter("field_name = 'location'")
    return v.groupBy(F.lower(F.split_part("canonical", F.lit(","), F.lit(1))).alias("term")).agg(
        F.min_by("market", "value_id").alias("value"), F.min("value_id").alias("ord")
    )


def location_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "positions").select("location").filter("location is not null").distinct()
    return R.longest_term(texts, _terms(spark, sf_dir), ["location"], "location")


def location_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated location, else that of a current position, else of any, by the first with a known region."""
    stated = people(spark, sf_dir, "location").select("candidate_id", "location", F.lit(0).alias("rank"), F.lit(-1).alias("pos"))
    work = roles(spark, sf_dir, "location").select(
        "candidate_id", "location", F.when(F.coalesce("is_current", F.lit(False)), 1).otherwise(2).alias("rank"), "pos"
    )
    places = stated.unionByName(work).filter("location is not null")
    known = R.longest_term(places.select("location").distinct(), _terms(spark, sf_dir), ["location"], "location")
    return places.join(known, "location").groupBy("candidate_id").agg(
        F.min_by(F.struct("value", "rank"), F.struct("rank", "pos", "value")).alias("b")
    ).select("candidate_id", F.col("b.value").alias("region"), F.col("b.rank").alias("source"))


def document_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _pairs(spark, SECTOR_WORDS, "term string, value string")
    return R.all_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, ["doc_id"], "text")


def tenure_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "years_experience")
    return c.select("candidate_id", R.band_of(F.col("years_experience"), BANDS).alias("band"))


def title_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "positions").select("title").filter("title is not null").distinct()
    return t.select("title", R.first_match(F.col("title"), TITLE_HINTS).alias("hint"))


def approach_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.create_map(*[F.lit(x) for p in (("fundamental", "fundamental"), ("systematic", "systematic_quant"), ("quantitative_dev", "systematic_quant"), ("hybrid", "hybrid"), ("unclear", "unclear")) for x in p])
    c = people(spark, sf_dir, "approach")
    return c.select("candidate_id", F.when(F.col("approach").isNotNull(), F.coalesce(F.try_element_at(family, F.col("approach")), F.lit("unclear"))).alias("family"))


def software_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "candidates").select(F.explode(F.split("software_tools", ";")).alias("tool"))
    return R.canonical_spelling(tools, _pairs(spark, SOFTWARE, "spelling string, canonical string"), "tool")


def credential_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names of stated credentials: exact, by letter case, then by a "Series N" at the start."""
    stated = spark.createDataFrame([(s,) for s in STATED], "raw string")
    book = spark.createDataFrame(CREDENTIALS, "code string, full_name string")
    key = F.regexp_extract(F.lower(F.trim("raw")), r"^(series \d+|[a-z ]+)", 1)
    return stated.withColumn("k", F.trim(key)).join(book, F.col("k") == F.lower("code"), "left").select(
        "raw", F.coalesce(F.concat_ws(" - ", "code", "full_name"), F.trim("raw")).alias("expanded")
    ).withColumn("expanded", F.when(F.col("expanded") == "", F.trim("raw")).otherwise(F.col("expanded")))


def employer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employers of each candidate with the kinds of employment held there, full-time and internships first."""
    p = roles(spark, sf_dir, "firm", "employment_type").filter("trim(firm) <> ''")
    rank = F.when(F.col("k") == "professional", 0).when(F.col("k") == "internship", 1).otherwise(2)
    kinds = p.select("candidate_id", "pos", F.col("firm").alias("f"), F.coalesce("employment_type", F.lit("")).alias("k"))
    g = kinds.groupBy("candidate_id", "f").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set(F.struct(rank.alias("r"), "k"))).alias("ks"))
    named = F.array_join(F.filter(F.transform("ks", lambda x: x["k"]), lambda k: k != ""), ", ")
    label = F.when(named == "", F.col("f")).otherwise(F.concat("f", F.lit(" ("), named, F.lit(")")))
    rows = g.select("candidate_id", F.struct("pos", label.alias("label")).alias("x"))
    return rows.groupBy("candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["label"]), " | ").alias("employers"))


def coverage_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = people(spark, sf_dir, "market_side", "region")
    stated = F.nullif(F.trim("market_side"), F.lit(""))
    region = F.nullif(F.trim("region"), F.lit(""))
    return c.select(
        "candidate_id",
        F.coalesce(stated, region, F.lit("unknown")).alias("market"),
        F.when(stated.isNotNull(), "stated").when(region.isNotNull(), "inferred").otherwise("unknown").alias("provenance"),
    )


def _linked(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Positions with the canonical name, type and resolution of their firm, through all tiers of the resolver."""
    firms = table(spark, sf_dir, "firms")
    p = roles(spark, sf_dir, "firm", *columns)
    links = R.resolve_fully(p, firms).join(firms.select("canonical", "firm_type"), "canonical", "left")
    return p.join(links, F.col("firm") == F.col("raw"), "left").drop("raw")


def market_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate has worked on either side, by the kinds of their resolved employers."""
    kinds = _linked(spark, sf_dir).groupBy("candidate_id").agg(F.collect_set("firm_type").alias("k"))
    return kinds.select(
        "candidate_id",
        F.arrays_overlap("k", F.array(*[F.lit(x) for x in BUY_SIDE])).alias("buy"),
        F.arrays_overlap("k", F.array(*[F.lit(x) for x in SELL_SIDE])).alias("sell"),
    )


def current_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first current professional position with its firm as resolved (as typed where it is not) and the firm's type."""
    p = _linked(spark, sf_dir, "title", "employment_type").filter("is_current and employment_type = 'professional'")
    shown = F.coalesce("canonical", "firm").alias("employer")
    first = p.groupBy("candidate_id").agg(F.min(F.struct("pos", "firm", "title", shown, "firm_type")).alias("r"))
    return first.select("candidate_id", "r.pos", "r.firm", "r.title", "r.employer", "r.firm_type")


QUERIES = {
    f.__name__: f
    for f in (
        firm_name_index, resolve_firms, resolve_fuzzy, firm_lineage, platform_alumni, location_region, location_fallback,
        document_sectors, tenure_band, title_hint, approach_family, software_canonical, credential_expand, employer_kinds,
        coverage_market, market_sides, current_role,
    )
}


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quoted([x]) for x in r) + f", {i})" for i, r in enumerate(rows))


_INDEX = f"""named AS (SELECT canonical, canonical AS name, false AS is_alias FROM firms
    UNION ALL SELECT canonical, unnest(aliases), true FROM firms),
  keyed AS (SELECT *, {SQL_FOLD.format("name")} AS key FROM named),
  idx AS (SELECT key, canonical, is_alias FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY is_alias, canonical) AS r
          FROM keyed WHERE key <> '') WHERE r = 1)"""
_LINE = """up(root, cur, lvl, path) AS (
    SELECT canonical, canonical, 0, [canonical] FROM firms
    UNION ALL SELECT u.root, f.parent, u.lvl + 1, list_append(u.path, f.parent) FROM up u JOIN firms f ON f.canonical = u.cur
    WHERE f.parent IS NOT NULL AND NOT list_contains(u.path[1:len(u.path) - 1], u.cur))"""
_TERM = """term AS (SELECT lower(split_part(canonical, ',', 1)) AS term, arg_min(market, value_id) AS value, min(value_id) AS ord
    FROM canon_values WHERE field_name = 'location' GROUP BY 1)"""


def _region(source: str) -> str:
    framed = r"' ' || trim(regexp_replace(regexp_replace(lower(location), '[^a-z0-9&+#./à-ÿ-]+|([a-z])[./-]+(\s|$)', '\1 ', 'g'), ' +', ' ', 'g')) || ' '"
    framed = "' ' || trim(regexp_replace(lower(location), '[\\s,;:()|/]+', ' ', 'g')) || ' '"
    return f"""{_TERM}, place AS (SELECT DISTINCT location FROM {source} WHERE location IS NOT NULL),
    hit AS (SELECT location, term, value, row_number() OVER (PARTITION BY location ORDER BY length(term) DESC, ord) AS r
            FROM place JOIN term ON contains({framed}, ' ' || term || ' ')),
    region AS (SELECT location, term, value FROM hit WHERE r = 1)"""


def _hint_case() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in TITLE_HINTS) + " END"


ORACLES = {
    "firm_name_index": f"WITH {_INDEX} SELECT * FROM idx",
    "resolve_firms": f"""
        WITH {_INDEX}, raw AS (SELECT DISTINCT firm AS raw FROM positions WHERE trim(firm) <> ''),
        k AS (SELECT raw, {SQL_FOLD.format("raw")} AS key,
                     CASE WHEN contains(raw, ',') AND length(trim(split_part(raw, ',', 1))) > 3
                          THEN {SQL_FOLD.format("trim(split_part(raw, ',', 1))")} END AS head_key FROM raw),
        t AS (SELECT k.raw, k.key, i.canonical, h.canonical AS of_head, {SQL_FOLD.format("i.canonical")} AS own_key
              FROM k LEFT JOIN idx i ON k.key = i.key LEFT JOIN idx h ON k.head_key = h.key),
        w AS (SELECT raw, unnest(list_distinct(string_split(key, ' '))) AS w FROM t WHERE canonical IS NULL AND of_head IS NULL),
        nw AS (SELECT * FROM w WHERE w <> ''),
        need AS (SELECT raw, count(*) AS need FROM nw GROUP BY 1),
        kn AS (SELECT key, canonical, len(list_distinct(string_split(key, ' '))) AS has, unnest(list_distinct(string_split(key, ' '))) AS w FROM idx),
        met AS (SELECT raw, key, canonical, has, count(*) AS met FROM nw JOIN kn USING (w) GROUP BY ALL),
        amb AS (SELECT raw, count(DISTINCT canonical) AS n FROM met JOIN need USING (raw) WHERE met = need AND has > need GROUP BY 1)
        SELECT t.raw, coalesce(canonical, of_head) AS canonical,
               CASE WHEN t.raw = canonical OR key = own_key THEN 'exact' WHEN canonical IS NOT NULL THEN 'alias'
                    WHEN of_head IS NOT NULL THEN 'division' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution
        FROM t LEFT JOIN amb ON t.raw = amb.raw""",
    "firm_lineage": f"WITH RECURSIVE {_LINE} SELECT root, cur AS ancestor, lvl FROM up WHERE lvl > 0",
    "location_region": f"WITH {_region('positions')} SELECT location, term, value FROM region",
    "location_fallback": f"""
        WITH {SQL_ROLES}, places AS (
          SELECT DISTINCT candidate_id, location, 0 AS rank, -1 AS pos FROM candidates
          UNION ALL SELECT candidate_id, location, CASE WHEN coalesce(is_current, false) THEN 1 ELSE 2 END, pos FROM roles),
        {_region("places")}
        SELECT candidate_id, arg_min(value, (rank, pos, value)) AS region, min(rank) AS source
        FROM places JOIN region USING (location) GROUP BY 1""",
    "document_sectors": f"""
        WITH t(term, value, ord) AS ({_values(SECTOR_WORDS)}),
        w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS term FROM documents)
        SELECT DISTINCT doc_id, value FROM w JOIN t USING (term)""",
    "tenure_band": f"SELECT DISTINCT candidate_id, {SQL_BAND.format('years_experience')} AS band FROM candidates",
    "title_hint": f"SELECT DISTINCT title, {_hint_case()} AS hint FROM positions WHERE title IS NOT NULL",
    "approach_family": """
        SELECT DISTINCT candidate_id, CASE WHEN approach IN ('systematic', 'quantitative_dev') THEN 'systematic_quant'
               WHEN approach IN ('fundamental', 'hybrid') THEN approach WHEN approach IS NOT NULL THEN 'unclear' END AS family FROM candidates""",
    "software_canonical": f"""
        WITH a(spelling, canonical, ord) AS ({_values(SOFTWARE)}),
        v AS (SELECT DISTINCT raw FROM (SELECT unnest(string_split(software_tools, ';')) AS raw FROM candidates) WHERE trim(raw) <> ''),
        h AS (SELECT raw, canonical, row_number() OVER (PARTITION BY raw ORDER BY length(spelling) DESC, ord) AS r FROM v JOIN a
              ON contains(' ' || regexp_replace(lower(trim(raw)), '[^a-z0-9+#&./-]+', ' ', 'g') || ' ', ' ' || spelling || ' '))
        SELECT v.raw, coalesce(h.canonical, trim(v.raw)) AS canonical FROM v LEFT JOIN h ON v.raw = h.raw AND h.r = 1""",
    "credential_expand": rf"""
        WITH b(code, full_name, ord) AS ({_values(CREDENTIALS)}), s(raw) AS (VALUES {", ".join(f"({quoted([x])})" for x in STATED)})
        SELECT raw, coalesce(code || ' - ' || full_name, trim(raw)) AS expanded
        FROM s LEFT JOIN b ON trim(regexp_extract(lower(trim(raw)), '^(series \d+|[a-z ]+)', 1)) = lower(code)""",
    "employer_kinds": f"""
        WITH {SQL_ROLES}, k AS (SELECT candidate_id, firm AS f, min(pos) AS pos FROM roles WHERE trim(firm) <> '' GROUP BY 1, 2),
        n AS (SELECT candidate_id, firm AS f, string_agg(DISTINCT employment_type, ', ' ORDER BY CASE employment_type WHEN 'professional' THEN '0'
              WHEN 'internship' THEN '1' ELSE '2' || employment_type END) AS ks FROM (SELECT DISTINCT candidate_id, firm, employment_type FROM roles
              WHERE employment_type <> '') GROUP BY 1, 2),
        l AS (SELECT candidate_id, pos, CASE WHEN ks IS NULL THEN f ELSE f || ' (' || ks || ')' END AS label FROM k LEFT JOIN n USING (candidate_id, f))
        SELECT candidate_id, string_agg(label, ' | ' ORDER BY pos, label) AS employers FROM l GROUP BY 1""",
    "coverage_market": """
        SELECT DISTINCT candidate_id, coalesce(nullif(trim(market_side), ''), nullif(trim(region), ''), 'unknown') AS market,
               CASE WHEN nullif(trim(market_side), '') IS NOT NULL THEN 'stated' WHEN nullif(trim(region), '') IS NOT NULL THEN 'inferred'
               ELSE 'unknown' END AS provenance FROM candidates""",
}
