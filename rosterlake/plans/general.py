"""Queries of the general data-preparation problems (1 and 3) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.months import month_number
from rosterlake.operators.interval_map import periods_and_gaps
from rosterlake.operators.packed_values import split_packed
from rosterlake.plans.interval_queries import P3_ORACLE
from rosterlake.session import table

PACKED_FIELDS = ["sectors", "asset_classes", "employers", "approach_keywords"]
LAST_MONTH = 2026 * 12 + 6


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields of every candidate, with its place."""
    return split_packed(table(spark, sf_dir, "candidates"), "candidate_id", PACKED_FIELDS).distinct()


def position_spans(positions: DataFrame, last_month: int = LAST_MONTH) -> DataFrame:
    """(candidate_id, start_month, end_month) of every position; end is capped at ``last_month``."""
    end = F.when(F.coalesce("is_current", F.lit(False)), F.lit(last_month)).otherwise(
        F.least(F.coalesce(month_number(F.col("end_date")), F.lit(last_month)), F.lit(last_month))
    )
    return positions.select("candidate_id", month_number(F.col("start_date")).alias("start_month"), end.alias("end_month"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of each career and the gaps between them."""
    return periods_and_gaps(position_spans(table(spark, sf_dir, "positions")), "candidate_id", "start_month", "end_month")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found}
ORACLES = {"p3_found": P3_ORACLE}
