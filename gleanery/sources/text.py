"""Tab-separated collections and TREC runs, read and written as plain text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def split_first_tab(line: Column) -> tuple[Column, Column]:
    """What is before and after the first tab; both null where there is none."""
    at = F.instr(line, "\t")
    head = F.when(at > 0, F.substring(line, F.lit(1), at - 1))
    return head, F.when(at > 0, F.substring(line, at + 1, F.length(line)))


def read_tsv(spark: SparkSession, path: str, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """(id, text) of lines ``id<TAB>text``; the text may hold more tabs and quotes.

    A trailing carriage return is dropped. Lines without a tab and with an empty id are skipped; an empty text stays. Of
    lines with one id each stays: collections are expected to have distinct ids, ``unique`` drops repeats.
    """
    line = F.regexp_replace("value", r"\r$", "")
    head, tail = split_first_tab(F.col("line"))
    rows = spark.read.option("lineSep", "\n").text(path).select(line.alias("line"))
    return rows.select(head.alias(id_name), tail.alias(text_name)).where(F.col(id_name) != "")


def unique(rows: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    return rows.groupBy(id_name).agg(F.max(text_name).alias(text_name))


def write_tsv(rows: DataFrame, path: str, id_name: str = "doc_id", text_name: str = "text") -> None:
    """Lines ``id<TAB>text``; white space in the text becomes single spaces, so that a row stays a line."""
    from gleanery.functions.text import clean

    line = F.concat(F.col(id_name).cast("string"), F.lit("\t"), clean(F.col(text_name)))
    rows.where(F.col(id_name).isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)


def slug(dataset: str) -> str:
    """A data set's name as part of a file name."""
    return dataset.replace("/", "_")


def export(documents: DataFrame, queries: DataFrame, out_dir: str, max_docs: int | None = None) -> None:
    """``corpus.tsv`` and ``queries.tsv`` of (doc_id, title, text) and (qid, query); ``max_docs`` takes the first ids.

    The title, if there is one, goes before the text.
    """
    from gleanery.functions.text import title_and_body

    text = title_and_body(F.col("title"), F.col("text")) if "title" in documents.columns else F.col("text")
    rows = documents.select("doc_id", text.alias("text"))
    if max_docs is not None:
        rows = rows.orderBy("doc_id").limit(max_docs)
    write_tsv(rows, f"{out_dir}/corpus.tsv")
    write_tsv(queries, f"{out_dir}/queries.tsv", "qid", "query")


@F.pandas_udf(StringType())
def _general(scores: pd.Series) -> pd.Series:
    """Six significant digits, as short as they can be written."""
    return scores.map(lambda x: None if x is None else f"{x:.6g}")


def run_lines(run: DataFrame, tag: str, decimals: int | None = 6) -> DataFrame:
    """(qid, rank, line) with TREC lines ``qid Q0 doc rank score tag``; no ``decimals`` means six significant digits."""
    score = F.col("score").cast("double")
    line = F.concat_ws(
        " ",
        F.col("qid").cast("string"),
        F.lit("Q0"),
        F.col("doc_id").cast("string"),
        F.col("rank").cast("string"),
        _general(score) if decimals is None else F.format_string(f"%.{decimals}f", score),
        F.lit(tag),
    )
    return run.select("qid", "rank", line.alias("line"))


def write_run(run: DataFrame, path: str, tag: str, decimals: int | None = 6) -> None:
    """Sorted by query and rank over all files."""
    run_lines(run, tag, decimals).sort("qid", "rank").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank, score, tag) of TREC lines, ranked again by score.

    Ties keep the order of the lines; the rank in the file is not read; lines under six fields are skipped.
    """
    from pyspark.sql import Window

    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f"), F.monotonically_increasing_id().alias("line")).where(F.size("f") >= 6)
    rows = rows.select(
        "line",
        F.col("f")[0].alias("qid"),
        F.col("f")[2].alias("doc_id"),
        F.col("f")[4].try_cast("double").alias("score"),
        F.col("f")[5].alias("tag"),
    )
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("line").asc())
    return rows.select("qid", "doc_id", F.row_number().over(order).alias("rank"), "score", "tag")
