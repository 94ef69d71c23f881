"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.clusters import kmeans, nearest_rows, unit
from gleanery.runtime import join_per_key, materialise, shuffle_partitions

#: Vectors a cell should hold; of n vectors there are up to ROOTS sqrt(n) cells, which sets the size of what is broadcast
#: (32 MB for a thousand million vectors of 64 parts). The sample the index is fitted on has up to PER_CELL for each cell
#: and SAMPLE in all, its code books up to BOOK_SAMPLE drawn from these. Every vector is indexed.
CELL, ROOTS, PER_CELL, SAMPLE, BOOK_SAMPLE = 256, 4, 32, 262_144, 65_536

#: Cells in a group: a task has a group's members, and a query is sent once to each group in which it visits cells.
GROUP = 32

#: Sub-vectors of the product quantiser, and their codes.
PARTS, CODES = 16, 256

#: Cells each query visits, nearest first: so many among FEW cells, and so many more for each doubling beyond.
PROBES, FEW, MORE = 20, 512, 4

#: Members of a group, and queries to it, in one task; larger groups are split by hash.
MEMBERS, QUERIES = 16_384, 32_768


def usable(vectors: DataFrame, dim: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): one row for each non-empty id with a vector of ``dim`` finite parts that aren't all zero.

    Of several different vectors under one id the greatest counts, in the order of arrays.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))
    rows = rows.where((F.col("id") != "") & (F.size(v) == dim)).where(~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


@dataclass
class Index:
    """Centroids (unit rows) and their groups, and for each sub-vector of the residuals a code book."""

    centroids: np.ndarray
    books: np.ndarray  # parts x codes x dim / parts
    groups: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, parts: int = PARTS, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        x = unit(sample).astype(np.float32)
        centroids = unit(kmeans(x, cells, rng, spherical=True)).astype(np.float32)
        residuals = x - centroids[nearest_rows(x, centroids, 1)[:, 0]]
        drawn = residuals[rng.choice(len(x), min(len(x), BOOK_SAMPLE), replace=False)]
        parts = max(p for p in range(1, parts + 1) if x.shape[1] % p == 0)
        width = x.shape[1] // parts
        codes = int(min(CODES, max(1, len(x) // 4)))
        books = [kmeans(drawn[:, p * width : (p + 1) * width], codes, rng) for p in range(parts)]
        books = np.stack([np.pad(b, ((0, codes - len(b)), (0, 0)), mode="edge") for b in books])
        near = kmeans(centroids, -(-len(centroids) // GROUP), rng, spherical=True)
        return cls(centroids, books, nearest_rows(centroids, near, 1)[:, 0])

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit rows, and the length of what the codes leave out: it bounds the error of any product."""
        residuals = x - self.centroids[cell]
        parts, _, width = self.books.shape
        codes = np.empty((len(x), parts), np.uint8)
        lost = np.zeros(len(x))
        for p, book in enumerate(self.books):
            r = residuals[:, p * width : (p + 1) * width]
            d = (book**2).sum(1)[None, :] - 2 * r @ book.T
            codes[:, p] = d.argmin(1)
            lost += ((r - book[codes[:, p]]) ** 2).sum(1)
        return codes, np.sqrt(lost)

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of the query rows with a cell's coded members, by tables of each query's products with the books."""
        parts, _, width = self.books.shape
        out = np.repeat((q @ self.centroids[cell])[:, None], len(codes), axis=1)
        for p, book in enumerate(self.books):
            table = q[:, p * width : (p + 1) * width] @ book.T
            out += np.take(table, codes[:, p], axis=1)
        return out


def most_similar(
    vectors: DataFrame,
    dim: int = 64,
    k: int = 5,
    least: float = 0.85,
    id_col: str = "id",
    vector_col: str = "embedding",
    probes: int | None = None,
    cell: int = CELL,
) -> DataFrame:
    """(id, neighbour, similarity, rank): up to ``k`` most similar other ids of each id with a usable vector.

    Similarity is the cosine rounded to 6 decimals; below ``least`` it doesn't count; ties go by ascending neighbour. A
    vector that is null, all zero, of another length or with a null, NaN or infinite part takes no part, nor does a null
    or empty id. Repeated rows count once; an empty table gives no rows.

    Every vector visits the ``probes`` cells nearest to it, whose number grows with that of the cells by default. There, products come from asymmetric distance tables over
    the residual codes; what the codes lost bounds the error, and each member that could still be among the first k is
    compared exactly. So all that can be missed lies in cells that were not visited. Equal vectors are one point of the
    index: a point stands for the k + 1 smallest of its ids, which are all that can be among anyone's first k.
    """
    points, copies, same = _points(usable(vectors, dim, id_col, vector_col))
    count = points.count()
    cells = int(max(1, min(count // cell, ROOTS * count**0.5)))
    if probes is None:
        probes = PROBES + int(MORE * max(0.0, np.log2(cells / FEW)))
    want = min(SAMPLE, max(PER_CELL * cells, 4096))
    sample = points.select("v") if count <= want else points.select("v").sample(min(1.0, 1.2 * want / count), seed=11).limit(want)
    trained = sample.toArrow().column("v").combine_chunks()  # at most SAMPLE rows
    trained = trained.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    if not len(trained):
        return points.select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    index = vectors.sparkSession.sparkContext.broadcast(Index.fit(trained, cells))
    hits = _hits(points, index, min(probes, cells), k, least)

    # Each point's first k points, then the ids these stand for.
    best = Window.partitionBy("id").orderBy(F.col("s").desc(), F.col("x").asc())
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("id", "x", "s")
    own = copies.select("rep").distinct().select(F.col("rep").alias("id"), F.col("rep").alias("x"), F.lit(1.0).alias("s"))
    hits = hits.unionByName(own)
    smallest = Window.partitionBy("rep").orderBy("id")
    stand = copies.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    stand = stand.select(F.col("rep").alias("x"), F.col("id").alias("m"))
    wide = hits.join(stand, "x", "left").select("id", F.coalesce("m", "x").alias("neighbour"), "s")
    order = Window.partitionBy("id").orderBy(F.col("s").desc(), F.col("neighbour").asc())
    wide = wide.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = materialise(
        wide.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "neighbour", "s"))).alias("l")), "lists"
    )
    # Copies take the list of their point; at most k + 1 entries each.
    of_copies = join_per_key(
        copies.select("rep", F.col("id").alias("copy")),
        lists.select(F.col("id").alias("rep"), "l").join(same, "rep"),
        "rep",
        "copies",
        count,
    ).select(F.col("copy").alias("id"), "l")
    of_points = lists.join(same.select(F.col("rep").alias("id")), "id", "left_anti").select("id", "l")
    all_ = of_points.unionByName(of_copies)
    others = F.filter("l", lambda e: e["neighbour"] != F.col("id"))
    rows = all_.select("id", F.posexplode(F.slice(others, 1, k)).alias("p", "e"))
    return rows.select(
        "id", F.col("e.neighbour").alias("neighbour"), F.col("e.s").alias("similarity"), (F.col("p") + 1).alias("rank")
    )


def _points(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, v) of each different vector under its smallest id; (id, rep) of vectors held by several ids; (rep, copies)."""
    digest = F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b"))
    rows = materialise(rows.withColumn("d", digest), "vectors")
    groups = rows.groupBy("d").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = materialise(groups, "equal")
    copies = materialise(join_per_key(rows.select("id", "d"), groups, "d", "copies", rows.count()).select("id", "rep"), "copies")
    points = rows.select("id", "v").join(copies.where("id <> rep").select("id"), "id", "left_anti")
    return materialise(points, "points"), copies, groups.select("rep", "copies")


def _hits(points: DataFrame, index, probes: int, k: int, least: float) -> DataFrame:
    """(id, x, s): for each point and each group it visits, its first k other points in the cells visited there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(np.float32)
            visited = nearest_rows(x, ix.centroids, probes)
            codes, lost = ix.encode(x, visited[:, 0])
            row = np.repeat(np.arange(len(x)), probes)
            group, cell = ix.groups[visited.ravel()], visited.ravel()
            order = np.lexsort((group, row))
            new = np.ones(len(row), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (group[order][1:] != group[order][:-1])
            first = np.flatnonzero(new)
            inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(cell[order], pa.int32()))
            visit = pa.StructArray.from_arrays([pa.array(group[order][first], pa.int32()), inner], ["group", "cells"])
            at = pa.array(np.searchsorted(row[order][first], np.arange(len(x) + 1)), pa.int32())
            columns = [*batch.columns, pa.array(ix.groups[visited[:, 0]], pa.int32()), pa.array(visited[:, 0], pa.int32())]
            columns += [pa.ListArray.from_arrays(at, visit), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "group", "cell", "visits", "codes", "lost"])

    kinds = "id string, v array<float>, group int, cell int, visits array<struct<group: int, cells: array<int>>>, codes binary, lost double"
    placed = materialise(points.select("id", "v").mapInArrow(place, kinds), "placed")
    # A row for each group: fewer than cells.
    members = placed.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    queries = placed.select(F.explode("visits.group").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("queries"))
    load = members.join(queries, "group").select(
        "group",
        F.ceil(F.col("members") / MEMBERS).cast("int").alias("mb"),
        F.ceil(F.col("queries") / QUERIES).cast("int").alias("qb"),
    )
    load = F.broadcast(materialise(load, "load"))
    h = F.xxhash64("id")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = placed.select("id", "v", "group", F.array("cell").alias("cells"), "codes", "lost").join(load, "group")
    mine = mine.withColumn("m", F.pmod(h, F.col("mb").cast("long")).cast("int")).withColumn("q", every("qb"))
    asked = placed.select("id", "v", F.explode("visits").alias("x")).select("id", "v", "x.group", "x.cells").join(load, "group")
    asked = asked.withColumn("q", F.pmod(h, F.col("qb").cast("long")).cast("int")).withColumn("m", every("mb"))
    columns = ["group", "m", "q", "kind", F.encode("id", "UTF-8").alias("id"), "v", "cells", "codes", "lost"]
    both = mine.withColumn("kind", F.lit(0)).select(columns).unionByName(
        asked.withColumns({"kind": F.lit(1), "codes": F.lit(None).cast("binary"), "lost": F.lit(None).cast("double")}).select(columns)
    )
    n = shuffle_partitions(points.sparkSession)
    keys = ["group", "m", "q"]
    # Members come before queries, so a task holds the members of one key and streams the queries past them.
    sorted_ = both.repartition(n, *keys).sortWithinPartitions(*keys, "kind")
    found = sorted_.mapInArrow(lambda it: _search(it, index.value, k, least), "id binary, x binary, s double")
    return found.select(F.decode("id", "UTF-8").alias("id"), F.decode("x", "UTF-8").alias("x"), "s")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(len(column), -1))


def _search(batches: Iterator[pa.RecordBatch], index: Index, k: int, least: float) -> Iterator[pa.RecordBatch]:
    key, held, ready = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]).any(axis=1)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            *mine, kind = parts[a].tolist()
            if mine != key:
                key, held, ready = mine, [], None
            rows = batch.slice(a, b - a)
            if kind == 0:
                held.append(rows)
            elif held:
                if ready is None:
                    ready = _Members(held)
                yield from ready.answers(rows, index, k, least)


class _Members:
    """The members of a group, by cell and ascending id."""

    def __init__(self, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        ids = np.array(t.column("id").to_pylist(), object)
        cells = t.column("cells").combine_chunks().flatten().to_numpy()
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.argsort(cells[by_id], kind="stable")]
        self.ids, self.v = ids[order], np.concatenate([_matrix(c) for c in t.column("v").chunks])[order]
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        self.slack = (t.column("lost").to_numpy()[order] + 2e-6).astype(np.float32)
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        self.place, self.sorted, self.at = place[order], ids[by_id], np.empty(len(ids), np.int64)
        self.at[self.place] = np.arange(len(ids))  # where the member of a place in the order of ids lies
        self.cells, first = np.unique(cells[order], return_index=True)
        self.bounds = np.append(first, len(ids))

    def answers(self, rows: pa.RecordBatch, index: Index, k: int, least: float) -> Iterator[pa.RecordBatch]:
        """The first k members of each query in the cells it visits."""
        names = np.array(rows.column("id").to_pylist(), object)
        q = _matrix(rows.column("v"))
        single = q.astype(np.float32)
        at = np.searchsorted(self.sorted, names)
        known = (at < len(self.sorted)) & (self.sorted[np.minimum(at, len(self.sorted) - 1)] == names)
        own = np.where(known, self.at[np.minimum(at, len(self.sorted) - 1)], -1)
        lists = rows.column("cells")
        visits = lists.flatten().to_numpy()
        of = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        order = np.argsort(visits, kind="stable")
        visits, of = visits[order], of[order]
        floor = np.full(len(q), np.float32(least))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c, a, z in zip(self.cells, self.bounds[:-1], self.bounds[1:]):
            asked = of[np.searchsorted(visits, c, "left") : np.searchsorted(visits, c, "right")]
            block = max(16, (1 << 20) // (z - a))
            for i in range(0, len(asked), block):
                found.append(self._cell(asked[i : i + block], c, a, z, q, single, own, floor, index, k))
        if not found:
            return
        a, b, s = (np.concatenate(x) for x in zip(*found))
        keep = s >= least
        a, b, s = a[keep], b[keep], s[keep]
        # By query, then similarity, then id.
        order = np.lexsort((self.place[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
        a, b, s = a[first], b[first], s[first]
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[a], pa.binary()), pa.array(self.ids[b], pa.binary()), pa.array(s, pa.float64())], ["id", "x", "s"]
            )

    def _cell(self, asked, c, a, z, q, single, own, floor, index, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact similarities of the queries to those members of a cell that may be among their first k; raises the floor."""
        near = index.approximate(single[asked], c, self.codes[a:z])
        # A query that is a member itself is no answer to itself.
        inside = np.flatnonzero((own[asked] >= a) & (own[asked] < z))
        near[inside, own[asked[inside]] - a] = -4
        slack = self.slack[None, a:z]
        if z - a > k:  # the k-th best of what is surely reached
            sure = near - slack
            floor[asked] = np.maximum(floor[asked], -np.partition(-sure, k - 1, axis=1)[:, k - 1])
        i, b = np.nonzero(near + slack >= floor[asked][:, None] - np.float32(2e-6))
        i, b = (x[near[i, b] > -3] for x in (i, b))
        return asked[i], b + a, np.round(np.einsum("ij,ij->i", q[asked[i]], self.v[b + a]), 6)
