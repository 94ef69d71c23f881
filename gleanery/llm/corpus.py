"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passages(corpus: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row (id, text) for each distinct non-empty id.

    Repeated rows count once; of several texts under one id the greatest in byte order counts, null only if all are
    null. Other columns are dropped, whatever their names.
    """
    rows = corpus.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.where("id is not null and id <> ''").groupBy("id").agg(F.max("text").alias("text"))


def finite(v: Column) -> Column:
    """The value as a double, null where it is not finite."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
