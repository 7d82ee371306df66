"""Shared inputs of the queries, and the SQL fragments of their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.months import MONTHS, month_number
from rosterlake.session import table

AS_OF = 2026 * 12 + 6
SECTORS = (
    "healthcare technology media_telecom financials energy utilities industrials consumer materials real_estate credit "
    "macro_rates_fx generalist other"
).split()
BANDS = [("junior", 5.0), ("mid", 9.0), ("senior", 99.0)]
TITLE_HINTS = [
    ("portfolio_manager", r"\b(portfolio manager|chief investment officer|managing director|partner|founder|head of)\b"),
    ("senior", r"\b(senior analyst|lead analyst|vice president|principal|sector head|director)\b"),
    ("junior", r"\b(junior analyst|research associate|research assistant|associate analyst)\b"),
    ("intern", r"\b(intern|internship|summer analyst|trainee)\b"),
]
BUY_SIDE = "pod_shop multi_strategy_platform hedge_fund crossover long_only asset_owner alternative_manager".split()
SELL_SIDE = "sell_side investment_bank".split()
PLATFORMS = "multi_strategy_platform pod_shop".split()


def people(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Candidate records, each once however often it was delivered."""
    return table(spark, sf_dir, "candidates").select("candidate_id", *columns).distinct()


def roles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Positions, each once, with their months as s and e."""
    rows = table(spark, sf_dir, "positions").select("candidate_id", "pos", "start_date", "end_date", "is_current", *columns).distinct()
    return rows.withColumns({"s": month_number(F.col("start_date")), "e": month_number(F.col("end_date"))})


def sector_list(text: Column) -> Column:
    """The known sectors named in a packed field, in order, by plain delimiters (reference queries; see packed_values)."""
    bare = F.regexp_replace(F.lower(text), r"[\[\]\"'•*()]|\b\d\b\.?", "")
    parts = F.transform(F.split(bare, r"[;|\n\t·,/&+]| and "), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("_")))
    return F.filter(F.array_distinct(parts), lambda x: x.isin(*SECTORS))


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SQL_SECTORS = (
    r"""list_filter(list_distinct(list_transform(regexp_split_to_array(regexp_replace(lower({0}), '[\[\]"''•*()]|\b\d\b\.?', '', 'g'),"""
    r""" '[;|\n\t·,/&+]| and '), lambda x: replace(trim(x), ' ', '_'))), lambda x: x IN ("""
    + quoted(SECTORS)
    + "))"
)
SQL_BAND = "CASE WHEN {0} <= 5 THEN 'junior' WHEN {0} <= 9 THEN 'mid' WHEN {0} IS NOT NULL THEN 'senior' END"
SQL_FOLD = (
    r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), '&', ' and '), '[.,''"()\-–—/]', ' ', 'g'),"""
    r""" '\b(ltd|limited|llc|llp|lp|inc|incorporated|corp|corporation|co|plc|pvt|private|group|holdings|company|management)\b', ' ', 'g'),"""
    r""" '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"""
)


def sql_month(column: str) -> str:
    """DuckDB expression of :func:`rosterlake.functions.months.month_number`."""
    t = rf"lower(trim(regexp_replace({column}, '[\s,]+', ' ', 'g')))"
    names = "|".join(MONTHS)
    ym = r"^(\d{4}) ?[-/.] ?(\d{1,2})(?: ?[-/.] ?\d{1,2})?(?:[ t].*)?$"
    my = r"^(?:\d{1,2} ?[-/.] ?)?(\d{1,2}) ?[-/.] ?(\d{4})$"
    ny = rf"^(?:\d{{1,2}}\.? )?({names})[a-z]*\.?[ ''/-]*(\d{{4}})$"
    yn = rf"^(\d{{4}})[ /-]*({names})[a-z]*\.?$"

    def part(pattern: str, group: int) -> str:
        return f"nullif(regexp_extract({t}, '{pattern}', {group}), '')"

    year = f"coalesce({part(ym, 1)}, {part(my, 2)}, {part(ny, 2)}, {part(yn, 1)}, {part(r'^(\d{4})$', 1)})::INT"
    named = f"(instr('{''.join(MONTHS)}', coalesce({part(ny, 1)}, {part(yn, 2)})) + 2) // 3"
    month = f"coalesce({part(ym, 2)}::INT, {part(my, 1)}::INT, {named}, CASE WHEN regexp_matches({t}, '^\\d{{4}}$') THEN 6 END)"
    return f"CASE WHEN {year} BETWEEN 1900 AND 2100 AND {month} BETWEEN 1 AND 12 THEN {year} * 12 + {month} END"


SQL_ROLES = f"""roles AS (
  SELECT *, {sql_month("start_date")} AS s, {sql_month("end_date")} AS e
  FROM (SELECT DISTINCT candidate_id, pos, firm, title, location, start_date, end_date, is_current, employment_type,
               is_investment_role, duration_months FROM positions))"""
SQL_SPANS = f"""{SQL_ROLES}, spans AS (
  SELECT * FROM (SELECT * EXCLUDE (e), CASE WHEN coalesce(is_current, false) THEN {AS_OF} ELSE least(coalesce(e, {AS_OF}), {AS_OF}) END AS e
                 FROM roles) WHERE e > s)"""
