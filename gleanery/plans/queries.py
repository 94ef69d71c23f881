"""The queries of the core, by name: (spark, directory of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import skew
from gleanery.plans import retrieval
from gleanery.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = table(spark, sf_dir, "postings").where("tf > 0")
    entries = table(spark, sf_dir, "term_entries")
    return skew.count_mismatches(valid, entries, ["shard", "term"], "doc_id", "df").select("shard", "term")


def queries() -> dict:
    return {f.__name__: f for f in [*retrieval.FUNCTIONS, p6_found]}
