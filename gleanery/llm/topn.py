"""The N highest-scoring items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.corpus import finite
from gleanery.runtime import fits_broadcast, join_per_key, materialise

#: Rows of a subgroup. A group is split by hash of the item into as many as it needs, and into two at least where it has
#: over SPLIT times as many rows as are kept.
SUBGROUP, SPLIT = 50_000, 10


def top_n(
    rows: DataFrame, groups: list[str], item: str, score: str, n: int = 10, subgroup: int = SUBGROUP
) -> DataFrame:
    """(groups..., item, score, rank): for each group its ``n`` items with the highest score, ties by ascending item.

    An item counts once a group, with its highest score. A null, NaN or infinite score and a null or empty item don't
    count. A null in a group column is a value like any other. Fewer than ``n`` items: all of them. Repeated rows change
    nothing; other columns are not read; an empty table gives no rows.

    The groups to be split are found by a count over the group columns alone and written out; their sizes are joined to
    the rows by broadcast if they were measured to fit, else by ``join_per_key``. One shuffle brings each subgroup to one
    task, which keeps the best score of each item and then ``n`` items; only these survivors are ranked again by group.
    """
    names = [f"g{i}" for i in range(len(groups))]
    group = F.struct(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, names)]).alias("g")
    plain = rows.select(group, F.col(f"`{item}`").alias("item"), finite(F.col(f"`{score}`")).alias("score"))
    valid = plain.where("score is not null and item is not null and cast(item as string) <> ''")
    # Rows that don't count are counted here, so that only the group columns are read.
    sizes = plain.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SPLIT * max(n, 1))
    sizes = materialise(sizes, "sizes")
    parts = F.greatest(F.lit(2), F.ceil(F.col("c") / subgroup)).cast("int")
    strings = [f"g.{k}" for k in names if plain.schema["g"].dataType[k].dataType.simpleString() == "string"]
    known = sizes.withColumn("parts", parts)
    joined = join_per_key(valid, known, "g", "c", plain.count(), fits_broadcast(sizes, 64, *strings), "left")
    salt = F.pmod(F.xxhash64("item"), F.coalesce(F.col("parts"), F.lit(1)).cast("long")).cast("int")
    salted = joined.select("g", salt.alias("salt"), "item", "score").repartition("g", "salt")
    best = salted.groupBy("g", "salt", "item").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("item").asc()]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("rank") <= n)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    return last.select(*[F.col(f"g.{k}").alias(g) for k, g in zip(names, groups)], F.col("item").alias(item), "score", "rank")
