"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm.canonical import map_to_reference
from rosterlake.llm.lookalikes import plain_forms
from rosterlake.llm.mixing import mix_shares, mix_sources
from rosterlake.llm.name_links import name_pairs
from rosterlake.llm.packing import near_mean_limits, pack, packing_report
from rosterlake.llm.reading_level import reading_levels
from rosterlake.llm.tokens import TOKENIZER, with_token_counts
from rosterlake.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry meant by every typed location, region and firm type."""
    fields = ["location", "region", "current_firm_type"]
    return map_to_reference(table(spark, sf_dir, "candidates"), "candidate_id", fields, table(spark, sf_dir, "canon_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of firm names that mean the same firm."""
    return name_pairs(table(spark, sf_dir, "firm_names"), "name_id", "name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form of every name and firm that differs from it."""
    return plain_forms(table(spark, sf_dir, "candidates"), "candidate_id", ["name", "current_firm"])


def _sized(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "doc_type", "text")
    return cut(with_token_counts(documents, tokenizer=tokenizer, prompt_col="n_prompt"))


def p6_packing(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of every piece of every document, for each packing spec, under limits near what the mean holds."""
    sized = _sized(spark, sf_dir, tokenizer)
    return pack(sized, near_mean_limits(sized, table(spark, sf_dir, "pack_specs")))


def p6_fill(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """How full the containers of each packing spec are, and how far each limit is used."""
    sized = _sized(spark, sf_dir, tokenizer)
    limits = cut(near_mean_limits(sized, table(spark, sf_dir, "pack_specs")))
    return packing_report(pack(sized, limits), limits)


def _drawn(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(cut(with_token_counts(documents, tokenizer=tokenizer)), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """How often each document is drawn for each mix."""
    return _drawn(spark, sf_dir, tokenizer)


def p7_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return mix_shares(_drawn(spark, sf_dir, tokenizer), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every English document of at least 60 words."""
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return reading_levels(english, table(spark, sf_dir, "reading_samples")).distinct()


QUERIES = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}
