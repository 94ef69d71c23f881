"""An index that grows with a stream of documents. The batch index never changes once built; this is an extension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gleanery.operators.index import Index


def append(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that adds a stream of (doc_id, text) to the index at ``path``.

    Each micro-batch writes its postings and documents under its own number, replacing what an attempt before it left,
    so a restarted query adds nothing twice. A document whose id is there already is left out: the first one stays.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("doc_id is not null").dropDuplicates(["doc_id"])
        try:
            old = spark.read.parquet(f"{path}/docs").where(f"batch <> {number}").select("doc_id")
            new = new.join(old, "doc_id", "left_anti")
        except AnalysisException:  # the first batch
            pass
        new = new.persist()
        part = Index.build(new)
        part.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        part.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        new.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> Index:
    """The index as of the batches written so far; term and collection statistics are those of all of them."""
    return Index.of(spark.read.parquet(f"{path}/postings").drop("batch"), spark.read.parquet(f"{path}/docs").drop("batch"))
