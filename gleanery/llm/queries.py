"""The queries of this subpackage, by name: (spark, directory of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, distinctive, neardup, packing, ranking, spam, termfreq, topn, vectors
from gleanery.llm.corpus import passages, table
from gleanery.runtime import materialise, spread

SCORES = ["bm25_score", "dense_score", "ce_score", "rrf_score"]


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(passages(table(spark, sf_dir, "corpus")), "passages")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_passages(spark, sf_dir), width=3, threshold=0.5).pairs()


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents at the usual five words, of any script, and 0.8."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    found = neardup.NearDuplicates(passages(docs), cut="units").every_text()
    return found.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), "copies", "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _passages(spark, sf_dir)
    return termfreq.marked(termfreq.term_counts(rows), rows.count()).where("mark is not null").select("term", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.term_counts(_passages(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.most_similar(table(spark, sf_dir, "doc_vectors"))
    pairs = near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return pairs.distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ranking.leaders(table(spark, sf_dir, "search_results"), "search_id", "doc_id", SCORES)
    return first.select("search_id", "doc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = topn.top_n(table(spark, sf_dir, "run_hits"), ["shard", "qid"], "external_id", "score")
    return hits.select("shard", "qid", "external_id")


def _distinctive(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    rows = _passages(spark, sf_dir)
    return distinctive.distinctiveness(rows, rows.count(), by=by)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinctive(spark, sf_dir, "tfidf").select("id", "term")


def p7_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _distinctive(spark, sf_dir, "residual")
    return top.select("id", "term", "tf", "df", F.round("residual", 4).alias("residual"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spread(table(spark, sf_dir, "documents")))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(spread(table(spark, sf_dir, "documents"))))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p9_packed(spark, sf_dir))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p9_packed``: all documents are there, none in vain in two pieces, no container is too full."""
    packed = materialise(p9_packed(spark, sf_dir), "packed")
    per = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.countDistinct("piece").alias("different"), F.max("piece").alias("last")
    )
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY))
    bad = (F.col("pieces") != needed) | (F.col("different") != F.col("pieces")) | (F.col("last") != F.col("pieces") - 1)
    documents = per.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(bad).alias("split_in_vain")
    )
    rooms = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > packing.CAPACITY).alias("too_full"))
    return documents.crossJoin(rooms)  # one row each


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(spread(table(spark, sf_dir, "documents"))).select("doc_id")


def queries() -> dict:
    found = [p1_found, p1_documents, p2_found, p2_counts, p3_found, p4_found, p5_found, p7_found, p7_residuals]
    return {f.__name__: f for f in [*found, p8_ids, p9_packed, p9_fill, p9_invariants, p10_found]}
