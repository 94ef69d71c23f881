"""Session-level helpers: materialised tables, size-checked broadcasts, spreading of small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows and bytes are at most these.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 48 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for each session.

    Workers run functions of the package; they may lack the driver's path.
    """
    context = spark.sparkContext
    if getattr(context, "_gleanery_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gleanery-code-"), "gleanery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)  # Spark's own file server hands it to the executors
    context._gleanery_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all is one machine.

    On a cluster a folder of one machine would lose the parts that other machines write, so RuntimeError is raised there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gleanery-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage and survives the loss of executors; the files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, bytes_per_row: int | None = None, *strings: str) -> bool:
    """Whether a table that is already materialised is small enough to broadcast, by count and bytes of its strings."""
    n, extra = df.agg(F.count(F.lit(1)), sum((F.sum(F.octet_length(c)) for c in strings), F.lit(0))).first()
    return n <= BROADCAST_ROWS and (extra or 0) + n * (bytes_per_row or 48) <= BROADCAST_BYTES


def partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows of an input that has fewer splits than the cluster has cores."""
    n = parallelism(df.sparkSession)
    return df if partitions(df) * 2 > n else df.repartition(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str, n_rows: int, fits: bool = False, how: str = "inner") -> DataFrame:
    """Join (inner, or left with ``how``) of ``rows`` with a table that has one row a key, ``weight`` saying how many rows hold the key.

    With ``fits`` (measured by ``fits_broadcast``) the table is broadcast. Else the keys that hold more than a quarter
    of a partition's fair share are, which are at most four for each partition, and the rest is joined by shuffle, so
    that no key's rows make a large task.
    """
    if fits:
        return rows.join(F.broadcast(per_key), key, how)
    share = max(1000, n_rows // (4 * shuffle_partitions(rows.sparkSession)))
    often, seldom = per_key.where(F.col(weight) > share), per_key.where(F.col(weight) <= share)
    hot = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key, how)
    return hot.unionByName(rest)
