"""An inverted index as tables: postings, document statistics, term statistics, collection statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import varint
from gleanery.functions.scoring import B, K1, bm25_weight, idf, varint_size
from gleanery.functions.text import shard_of, tokens
from gleanery.runtime import fits_broadcast, join_per_key, materialise, shared_path, shuffle_partitions


@dataclass
class Index:
    """Tables of an index; all of them have the columns ``by`` first if it is split, as by shard.

    ``postings``: (term, doc_id, tf, dl). ``docs``: (doc_id, dl), documents of length 0 included. ``terms``: (term, df,
    cf, max_tf, min_dl). ``stats``: (n, avgdl), a row for each part. ``words``: (doc_id, w), the documents' tokens, of an
    index that is only planned.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    by: tuple[str, ...] = ()
    _forward: DataFrame | None = None
    words: DataFrame | None = None

    @classmethod
    def build(cls, documents: DataFrame, by: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> Index:
        """From (doc_id, text, by...) with distinct ids; a null or empty text is a document of length 0."""
        of = [F.col(f"`{c}`") for c in by]
        words = documents.select(*of, F.col(f"`{id_col}`").alias("doc_id"), tokens(F.col(f"`{text_col}`")).alias("w"))
        words = words.select(*by, "doc_id", F.size("w").alias("dl"), "w")
        postings = (
            words.select(*by, "doc_id", "dl", F.explode("w").alias("term"))
            .groupBy(*by, "term", "doc_id", "dl")
            .agg(F.count(F.lit(1)).cast("int").alias("tf"))
            .select(*by, "term", "doc_id", "tf", "dl")
        )
        ix = cls.of(postings, words.select(*by, "doc_id", "dl"), by)
        ix.words = words.select(*by, "doc_id", "w")
        return ix

    @classmethod
    def of(cls, postings: DataFrame, docs: DataFrame, by: tuple[str, ...] = ()) -> Index:
        terms = postings.groupBy(*by, "term").agg(
            F.count(F.lit(1)).alias("df"),
            F.sum("tf").alias("cf"),
            F.max("tf").alias("max_tf"),
            F.min("dl").alias("min_dl"),
        )
        stats = docs.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
        )
        return cls(postings, docs, terms, stats, by)

    @property
    def forward(self) -> DataFrame:
        """(by..., doc_id, dl, terms): the terms of each document with their tf."""
        if self._forward is not None:
            return self._forward
        return self.postings.groupBy(*self.by, "doc_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))

    def write(self, path: str) -> None:
        """Postings and terms are sorted by term within their files, so that a filter on terms skips row groups.

        What the index is split by is written beside it.
        """
        self.postings.repartitionByRange(*self.by, "term", "doc_id").sortWithinPartitions(*self.by, "term", "doc_id").write.mode(
            "overwrite"
        ).parquet(f"{path}/postings")
        for name in ("docs", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.terms.sort(*self.by, "term").write.mode("overwrite").parquet(f"{path}/terms")
        read = self.postings.sparkSession.read.parquet(f"{path}/postings")
        forward = Index(read, self.docs, self.terms, self.stats, self.by).forward
        forward.repartitionByRange(*self.by, "doc_id").sortWithinPartitions(*self.by, "doc_id").write.mode("overwrite").parquet(f"{path}/forward")
        meta = self.postings.sparkSession.createDataFrame([(list(self.by),)], "by array<string>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str, by: tuple[str, ...] | None = None) -> Index:
        """An index written before, split as it was written.

        Spark raises AnalysisException if there is none, and ValueError is raised if its columns are others or if it is
        not split by ``by`` where that is given.
        """
        need = {"postings": {"term", "doc_id", "tf", "dl"}, "docs": {"doc_id", "dl"}, "terms": {"term", "df"}, "stats": {"n", "avgdl"}}
        read = {}
        for name, columns in need.items():
            read[name] = spark.read.parquet(f"{path}/{name}")
            if missing := columns - set(read[name].columns):
                raise ValueError(f"not an index: {name} lacks {', '.join(sorted(missing))}")
        kept = tuple(spark.read.parquet(f"{path}/meta").first()["by"])
        if by is not None and tuple(by) != kept:
            raise ValueError(f"the index is split by {list(kept)}, not by {list(by)}")
        return cls(*read.values(), kept, spark.read.parquet(f"{path}/forward"))

    def stored(self) -> Index:
        """The same index, written to the shared folder and opened."""
        path = shared_path(self.postings.sparkSession, "index")
        self.write(path)
        return Index.open(self.postings.sparkSession, path, self.by)

    def df(self, term: str) -> DataFrame:
        return self.terms.where(F.col("term") == term).select(*self.by, "df")

    def lookup(self, *terms: str) -> DataFrame:
        return self.postings.where(F.col("term").isin(*terms))

    def with_idf(self) -> DataFrame:
        """Terms with ``idf`` and the collection statistics, which are a row for each part."""
        stats = F.broadcast(self.stats)
        joined = self.terms.join(stats, list(self.by)) if self.by else self.terms.crossJoin(stats)
        return joined.withColumn("idf", idf(F.col("n"), F.col("df")))

    def impacts(self, k1: float = K1, b: float = B) -> DataFrame:
        """(by..., term, doc_id, impact): what a posting adds to a query with that term once."""
        terms = self.with_idf().select(*self.by, "term", "df", "idf", "avgdl")
        key = F.struct(*self.by, "term").alias("__k")
        rows, terms = self.postings.withColumn("__k", key), terms.select(key, "df", "idf", "avgdl")
        held = self.terms.select(*self.by, "term")
        joined = join_per_key(rows, terms, "__k", "df", self.postings.count(), fits_broadcast(held, 80, "term"))
        weight = F.col("idf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        return joined.select(*self.by, "term", "doc_id", weight.alias("impact"))

    def bounds(self, k1: float = K1, b: float = B) -> DataFrame:
        """(by..., term, bound): no posting of the term adds more."""
        weight = F.col("idf") * bm25_weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b)
        return self.with_idf().select(*self.by, "term", weight.alias("bound"))


def with_shard(documents: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    return documents.withColumn("shard", shard_of(F.col(id_col), shards))


def _ranged(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with ``__p``, the part of a range partition by (by..., order) they lie in: long lists fill many parts."""
    n = shuffle_partitions(rows.sparkSession)
    return materialise(rows.repartitionByRange(n, *by, order).withColumn("__p", F.spark_partition_id()), "ranged")


def _carried(per_part: DataFrame, by: list[str], value) -> DataFrame:
    """(by..., __p, carry): ``value`` over a list's parts before each part. A part continues one list at most, so these
    are fewer than the parts."""
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(*by, "__p", value.over(before).alias("carry")).where("carry is not null")


def gaps(postings: DataFrame, by: list[str], doc: str = "doc_id") -> DataFrame:
    """Postings with ``gap``: the distance of each document's number from the one before in its list; the first is itself.

    Lists are cut by ranges, so that a term found everywhere is no large task; what a part's first posting lacks is
    carried over from the parts before.
    """
    rows = _ranged(postings, by, doc)
    carry = _carried(rows.groupBy(*by, "__p").agg(F.max(doc).alias("last")), by, F.max("last"))
    before = F.lag(doc).over(Window.partitionBy("__p", *by).orderBy(doc))
    joined = rows.withColumn("__before", before).join(F.broadcast(carry), [*by, "__p"], "left")
    gap = F.col(doc) - F.coalesce("__before", "carry", F.lit(0))
    return joined.select(*postings.columns, gap.alias("gap"))


def from_gaps(gapped: DataFrame, by: list[str], position: str, gap: str = "gap") -> DataFrame:
    """The documents' numbers back from the gaps, by running sums over the parts of each list."""
    rows = _ranged(gapped, by, position)
    carry = _carried(rows.groupBy(*by, "__p").agg(F.sum(gap).alias("total")), by, F.sum("total"))
    frame = Window.partitionBy("__p", *by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("__sum", F.sum(gap).over(frame)).join(F.broadcast(carry), [*by, "__p"], "left")
    return joined.select(*gapped.columns, (F.col("__sum") + F.coalesce("carry", F.lit(0))).alias("doc_id"))


#: Numbers of documents that one packed list may span; longer lists are cut.
SPAN = 1 << 20


def pack_lists(postings: DataFrame, by: list[str], doc: str = "doc_id") -> DataFrame:
    """(by..., block, n, raw): posting lists as bytes, gap and tf of each document as variable-length numbers.

    A list is cut into blocks of SPAN document numbers, each of which begins anew, so none has to be packed in one task.
    """
    cut = postings.select(*by, F.floor(F.col(doc) / SPAN).cast("int").alias("block"), F.col(doc).cast("long").alias("doc"), F.col("tf").cast("long").alias("tf"))
    keys = [*by, "block"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        doc, tf = (table.column(c).to_numpy() for c in ("doc", "tf"))
        new = np.zeros(len(doc), bool)
        new[0] = True
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = np.flatnonzero(new)
        before = np.concatenate([[0], doc[:-1]])
        before[first] = 0
        flat = np.stack([doc - before, tf], axis=1).ravel()
        raw, size = varint.encode(flat), varint.sizes(flat).reshape(-1, 2).sum(axis=1)
        ends = np.cumsum(np.add.reduceat(size, first))
        blobs = [raw[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        n = np.diff(np.append(first, len(doc)))
        at = pa.array(first)
        columns = [table.column(k).combine_chunks().take(at) for k in keys] + [pa.array(n, pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "n", "raw"])

    return cut.repartition(*keys).sortWithinPartitions(*keys, "doc").mapInArrow(run, f"{kinds}, n int, raw binary")


def unpack_lists(lists: DataFrame, by: list[str], doc: str = "doc_id") -> DataFrame:
    """(by..., doc, tf) of packed lists; ValueError from the task where one breaks off."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields if f.name in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.array(varint.decode(b"".join(batch.column(len(by) + 1).to_pylist())), np.int64).reshape(-1, 2)
            n = batch.column(len(by)).to_numpy()
            first = np.cumsum(n) - n
            total = np.cumsum(flat[:, 0])
            ids = total - np.repeat(total[first] - flat[first, 0], n)
            row = pa.array(np.repeat(np.arange(batch.num_rows), n))
            columns = [batch.column(i).take(row) for i in range(len(by))] + [pa.array(ids), pa.array(flat[:, 1], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*by, doc, "tf"])

    return lists.select(*by, "n", "raw").mapInArrow(run, f"{kinds}, `{doc}` bigint, tf int")


def size_report(postings: DataFrame, shard: str = "shard", doc: str = "doc_id") -> DataFrame:
    """A row for each shard and one for all (null): documents, terms, postings, raw and compressed bytes and their ratio.

    A term found in several shards counts in each. Raw is 8 bytes a posting; compressed is gap and tf as variable-length
    numbers; ``percent`` is how much of the raw size that saves, ``mib`` what is left in MiB.
    """
    valid = postings.where(F.col(doc).isNotNull() & (F.col("tf") > 0)).groupBy(shard, "term", doc).agg(F.max("tf").alias("tf"))
    sized = gaps(valid, [shard, "term"], doc).select(
        shard, "term", doc, (varint_size(F.col("gap")) + varint_size(F.col("tf"))).alias("bytes")
    )
    lists = sized.groupBy(shard, "term").agg(F.count(F.lit(1)).alias("postings"), F.sum("bytes").alias("bytes"))
    per = lists.groupBy(shard).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("postings").alias("postings"), F.sum("bytes").alias("compressed")
    )
    docs = valid.select(shard, doc).distinct().groupBy(shard).agg(F.count(F.lit(1)).alias("docs"))
    total = per.join(docs, shard).rollup(shard).agg(*[F.sum(c).alias(c) for c in ("docs", "terms", "postings", "compressed")])
    return total.select(
        shard,
        "docs",
        "terms",
        "postings",
        (F.col("postings") * 8).alias("raw"),
        "compressed",
        F.round(F.try_divide(F.col("postings") * F.lit(8.0), F.col("compressed")), 4).alias("ratio"),
        F.round(100 - F.try_divide(F.col("compressed") * F.lit(12.5), F.col("postings")), 4).alias("percent"),
        F.round(F.col("compressed") / F.lit(float(1 << 20)), 4).alias("mib"),
    )
