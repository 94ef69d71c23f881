"""Per-key results although a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import shuffle_partitions


def distinct_per_key(rows: DataFrame, keys: list[str], member: str, partitions: int | None = None) -> DataFrame:
    """(keys..., n): how many different members each key has, null keys being keys and null members not counting.

    Rows are partitioned by range of the composite (keys..., member, input partition), with boundaries from Spark's
    sampled quantiles, and sorted there: a key with most of the rows is cut into as many partitions as it fills, and so
    is a single pair that repeats so often. A pass over each sorted partition gives one state for each key in it: the
    number of different members, the first and the last of them. Only keys that cross a boundary have several
    states; these are stitched: the numbers are added, less one wherever a state begins with the member that the one
    before ended with. Repeated rows and other columns change nothing; an empty table gives no rows.
    """
    named = [f"k{i}" for i in range(len(keys))]
    pairs = rows.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named)],
        F.col(f"`{member}`").alias("m"),
        F.spark_partition_id().alias("at"),
    ).where("m is not null")
    count = partitions or shuffle_partitions(rows.sparkSession)
    ranged = pairs.repartitionByRange(count, *named, "m", "at").sortWithinPartitions(*named, "m").drop("at")
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in named) + f", n bigint, first {kinds['m']}, last {kinds['m']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _states(batches, len(named))

    states = ranged.mapInArrow(run, schema)
    pieces = states.groupBy(*named).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cut")
    )
    again = F.size(
        F.filter(
            F.sequence(F.lit(2), F.size("cut")),
            lambda i: F.element_at("cut", i)["first"] == F.element_at("cut", i - 1)["last"],
        )
    )
    n = F.when(F.size("cut") > 1, F.col("n") - again).otherwise(F.col("n"))
    return pieces.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], n.alias("n"))


def _states(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One state for each run of equal keys in the sorted rows; a run may go over several batches."""
    names = None
    open_: pa.RecordBatch | None = None  # the state of the run that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        names = names or [*batch.schema.names[:keys], "n", "first", "last"]
        columns = batch.columns
        changed = [_changed(c) for c in columns]
        new_key = np.logical_or.reduce(changed[:keys]) if keys else np.zeros(batch.num_rows - 1, bool)
        new_pair = new_key | changed[keys]
        begins = np.concatenate([[0], np.flatnonzero(new_key) + 1])
        ends = np.concatenate([begins[1:], [batch.num_rows]]) - 1
        pairs = np.concatenate([[1], new_pair.astype(np.int64)])
        n = np.add.reduceat(pairs, begins)
        member = columns[keys]
        states = pa.RecordBatch.from_arrays(
            [*[c.take(pa.array(begins)) for c in columns[:keys]], pa.array(n), member.take(pa.array(begins)), member.take(pa.array(ends))],
            names,
        )
        if open_ is not None:
            if all(open_.column(k)[0].as_py() == states.column(k)[0].as_py() for k in range(keys)):
                same = open_.column(keys + 2)[0].as_py() == states.column(keys + 1)[0].as_py()
                total = open_.column(keys)[0].as_py() + int(n[0]) - same
                joined = pa.RecordBatch.from_arrays(
                    [*[c.slice(0, 1) for c in states.columns[:keys]], pa.array([total], pa.int64()), open_.column(keys + 1), states.column(keys + 2).slice(0, 1)],
                    names,
                )
                states = pa.Table.from_batches([joined, states.slice(1)]).combine_chunks().to_batches()[0]
            else:
                yield open_
        if states.num_rows > 1:
            yield states.slice(0, states.num_rows - 1)
        open_ = states.slice(states.num_rows - 1)
    if open_ is not None:
        yield open_


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before, null being equal to null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def count_mismatches(rows: DataFrame, entries: DataFrame, keys: list[str], member: str, recorded: str) -> DataFrame:
    """(keys..., n, recorded): keys whose number of different members differs from the recorded one.

    No member, no entry and a null in ``recorded`` each count as 0. Entries that repeat count once; of several
    different entries of a key each one that differs gives a row.
    """
    named = [f"k{i}" for i in range(len(keys))]
    left = distinct_per_key(rows, keys, member).toDF(*named, "n")
    right = entries.select(*[F.col(f"`{k}`").alias(f"e{i}") for i, k in enumerate(keys)], F.col(f"`{recorded}`").alias("r"))
    both = left.join(right.distinct(), [F.col(n).eqNullSafe(F.col(f"e{i}")) for i, n in enumerate(named)], "full_outer")
    n, r = F.coalesce("n", F.lit(0)), F.coalesce(F.col("r").cast("long"), F.lit(0))
    pick = [F.when(F.col("n").isNotNull(), F.col(a)).otherwise(F.col(f"e{i}")).alias(k) for i, (a, k) in enumerate(zip(named, keys))]
    return both.select(*pick, n.alias("n"), r.alias("recorded")).where("n <> recorded")
