"""Dense retrieval: exact and by cells, encoders as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.clusters import kmeans, nearest_rows
from gleanery.functions.scoring import l2_normalise, norm
from gleanery.runtime import materialise

#: Query vectors that are held by a task at a time.
QUERIES = 20_000

#: Vectors the cells of the approximate search are fitted on, at most, and of these such as are taken as queries.
SAMPLE, TRIED = 50_000, 512


def _shaped(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, v) rows whose vector has ``dim`` finite parts and isn't all zero, at unit length."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where((F.size("v") == dim) & ~bad & (norm(F.col("v")) > 0))
    return rows.select("id", l2_normalise(F.col("v")).alias("v"))


def knn(documents: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, decimals: int = 4) -> DataFrame:
    """(qid, doc_id, score, rank): the ``k`` nearest of (id, v) ``documents`` by cosine, for each of (id, v) ``queries``.

    Scores are rounded before they are ranked, ties by ascending id. Each task multiplies its documents, batch by batch,
    with the query vectors, which are broadcast in passes of QUERIES, and sends on those that reach the k-th best score
    it has seen of the query; no vector of a document is moved. A vector of another length, or with a null or
    non-finite part, or all zero, takes no part.
    """
    return _nearest(_shaped(documents, dim), _shaped(queries, dim), k, dim, decimals, None, 0)


def _nearest(docs: DataFrame, asked: DataFrame, k: int, dim: int, decimals: int, centroids: np.ndarray | None, probes: int) -> DataFrame:
    passes = max(1, -(-asked.count() // QUERIES))
    spark = docs.sparkSession
    out = None
    for i in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i) if passes > 1 else asked
        rows = mine.toArrow().combine_chunks()  # about QUERIES rows
        q = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        visits = None if centroids is None else nearest_rows(q, centroids, probes)
        held = spark.sparkContext.broadcast((rows.column("id").combine_chunks(), q, centroids, visits))
        found = _products(docs, held, k, decimals, asked.schema["id"].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _products(docs: DataFrame, held, k: int, decimals: int, qid_type: str) -> DataFrame:
    """(qid, doc_id, score): of every batch what may be among the first k; with cells, of those a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, centroids, visits = held.value
        if not len(qids) or k <= 0:
            return
        best = np.full((len(qids), k), -np.inf)  # the k best scores this task has seen of each query
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if centroids is None:
                parts = [(np.arange(len(qids)), np.arange(len(x)))]
            else:
                cell = nearest_rows(x, centroids, 1)[:, 0]
                asking, of = np.nonzero(np.isin(visits, np.unique(cell))), visits
                by_cell: dict[int, list] = {}
                for row, c in zip(asking[0].tolist(), of[asking].tolist()):
                    by_cell.setdefault(c, []).append(row)
                parts = [(np.array(rows), np.flatnonzero(cell == c)) for c, rows in by_cell.items()]
            for rows, members in parts:
                for at in range(0, len(rows), 256):
                    mine = rows[at : at + 256]
                    s = np.round(q[mine] @ x[members].T, decimals)
                    both = np.concatenate([best[mine], s], axis=1)
                    best[mine] = -np.partition(-both, k - 1, axis=1)[:, :k]
                    a, b = np.nonzero(s >= best[mine].min(axis=1)[:, None])
                    if not len(a):
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(mine[a])), batch.column(0).take(pa.array(members[b])), pa.array(s[a, b])],
                        ["qid", "doc_id", "score"],
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "v").mapInArrow(run, f"qid {qid_type}, doc_id {kind}, score double")


def ann(
    documents: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, recall: float = 0.99, decimals: int = 4,
    cells: int | None = None, probes: int | None = None,
) -> DataFrame:
    """As ``knn`` but each query only meets the documents of its ``probes`` nearest cells.

    Cells are those of a k-means over up to SAMPLE of the documents, by default about as many as the root of their
    number; every document lies in one. Where ``probes`` isn't given it is the least number with which TRIED of the
    sample, taken as queries, find a share ``recall`` of their own nearest in the sample: collections that fall into
    groups need few. Documents are scored where they lie, so a large cell is no large task.
    """
    docs = materialise(_shaped(documents, dim), "vectors")
    n = docs.count()
    if not n:
        return knn(documents, queries, k, dim, decimals)
    part = docs if n <= SAMPLE else docs.sample(SAMPLE / n, seed=3)
    sample = part.select("v").toArrow().column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)  # about SAMPLE rows
    rng = np.random.default_rng(3)
    centroids = kmeans(sample.astype(np.float32), min(cells or max(1, round(n**0.5)), max(1, len(sample) // 4)), rng, spherical=True)
    centroids = centroids.astype(np.float64)
    return _nearest(docs, _shaped(queries, dim), k, dim, decimals, centroids, min(probes or _probes(sample, centroids, k, recall, rng), len(centroids)))


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
    tried = rng.choice(len(sample), min(TRIED, len(sample)), replace=False)
    s = sample[tried] @ sample.T
    s[np.arange(len(tried)), tried] = -np.inf
    k = max(1, min(k, len(sample) - 1))
    nearest = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = nearest_rows(sample[tried], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids), dtype=order.dtype)[None, :], axis=1)
    needed = np.take_along_axis(place, nearest_rows(sample, centroids, 1)[:, 0][nearest], axis=1) + 1
    return int(np.quantile(needed, recall, method="higher"))


def hashing_encoder(dim: int = 64) -> Callable[[pd.Series], list[np.ndarray]]:
    """Stand-in for a bi-encoder: each token adds a sign at a place its CRC picks; unit length, zero without tokens."""
    import re
    import zlib

    word = re.compile("[A-Za-z0-9]+")

    def encode(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(dim, np.float32)
            for w in word.findall(text or ""):
                h = zlib.crc32(w.lower().encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return out

    return encode


# Fixed value: the instruction that models of the bge family were trained with for queries.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "


def instruction(kind: str, model: str) -> str:
    """What goes before each text: queries of those models alone take an instruction."""
    family = "bge" in model.lower()
    return QUERY_INSTRUCTION if family and kind == "query" else ""


def embed(
    texts: DataFrame, load: Callable[[], Callable] = hashing_encoder, text_col: str = "text", instruction: str = "",
    batch: int = 256, max_length: int | None = None,
) -> DataFrame:
    """``texts`` with ``embedding``; ``load`` makes the encoder once in each worker.

    The encoder gets ``batch`` texts at a time, each cut to its first ``max_length`` tokens if given, as models are, with
    ``instruction`` before it.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for series in batches:
            out: list = []
            for at in range(0, len(series), batch):
                out += list(encode(series.iloc[at : at + batch]))
            yield pd.Series(out)

    text = F.coalesce(F.col(text_col), F.lit(""))
    if max_length is not None:
        text = F.array_join(F.slice(F.split(text, r"\s+"), 1, max_length), " ")
    return texts.withColumn("embedding", run(F.concat(F.lit(instruction), text)))


def write_vectors(vectors: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """(id, embedding) as Parquet, each row's id with its vector."""
    vectors.select(F.col(id_col).alias("id"), "embedding").write.mode("overwrite").parquet(path)


def read_vectors(spark, path: str) -> DataFrame:
    """(id, v) of vectors written before; ValueError if the columns are others."""
    rows = spark.read.parquet(path)
    if {"id", "embedding"} - set(rows.columns):
        raise ValueError(f"no vectors: {path} has {', '.join(rows.columns)}")
    return rows.select("id", F.col("embedding").cast("array<double>").alias("v"))
