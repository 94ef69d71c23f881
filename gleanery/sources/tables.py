"""The tables of a directory, cleaned to what the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, shard): a row for each distinct non-empty id of the corpus."""
    rows = table(spark, sf_dir, "corpus").where("id is not null and id <> ''")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.max("text").alias("text"), F.min("shard").alias("shard"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): a row for each qid."""
    rows = table(spark, sf_dir, "queries").where("qid is not null")
    return rows.groupBy("qid").agg(F.max("query").alias("query"))


def logged_run(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """(qid, doc_id, score, rank): the ``k`` best logged passages of each query over all shards, by their best score."""
    from pyspark.sql import Window

    s = F.col("score")
    usable = (F.col("external_id") != "") & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    best = table(spark, sf_dir, "run_hits").where(usable).groupBy("qid", F.col("external_id").alias("doc_id")).agg(
        F.round(F.max("score"), 6).alias("score")
    )
    order = Window.partitionBy("qid").orderBy(s.desc(), F.col("doc_id").asc())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def logged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, term, doc_id, tf): the valid postings, one row each."""
    rows = table(spark, sf_dir, "postings").where("doc_id is not null and tf > 0")
    return rows.groupBy("shard", "term", "doc_id").agg(F.max("tf").alias("tf"))
