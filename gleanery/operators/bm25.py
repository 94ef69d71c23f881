"""BM25 over whole batches of queries: relational, by blocks of documents, pruned, and by shard.

All give (by..., qid, doc_id, score, rank): the ``k`` best documents of each query, scores rounded to 6 decimals before
they are ranked, ties by ascending doc_id. A term counts as often as it occurs in the query; a document with any term of
the query qualifies; a null, empty or unknown query has no rows, nor has any for ``k`` = 0.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType

from gleanery.functions.scoring import B, K1, bm25_weight, idf
from gleanery.functions.text import tokens
from gleanery.operators.index import Index
from gleanery.runtime import fits_broadcast, materialise, spread

#: Query terms that are broadcast at a time, and entries of the tables of idf by part and term; more queries are scored
#: in several passes.
QUERY_TERMS, ENTRIES = 500_000, 4_000_000

#: Documents scored at once in a task: each such block sends on the first k of a query.
DOCUMENTS = 32_768


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf) of (qid, query) rows; a qid that repeats counts with its greatest text."""
    one = queries.where("qid is not null").groupBy("qid").agg(F.max("query").alias("query"))
    words = one.select("qid", F.explode(tokens(F.col("query"))).alias("term"))
    return words.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("int").alias("qtf"))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = (), score: str = "score", item: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(*by, "qid").orderBy(F.col(score).desc(), F.col(item).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _part(k1: float, b: float):
    return F.col("qtf") * F.col("idf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], *strings: str) -> DataFrame:
    """Join with a written table, which is broadcast if it was measured to fit; else AQE splits what is skewed."""
    return rows.join(F.broadcast(small) if fits_broadcast(small, 128, *strings) else small, keys)


def search(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """By joins: query terms meet their postings, contributions are summed by (query, document).

    Where the lists of all queries are together longer than the index (``_rather_blocks``), these rows are not made: the
    index is read once and scored by blocks, as in ``search_index``. An index that is split gives a ranking for each
    part, by the part's own statistics.
    """
    by = index.by
    if _rather_blocks(index, queries):
        return search_index(index, queries, k, k1, b)
    terms = materialise(query_terms(queries).join(index.with_idf().select(*by, "term", "idf", "avgdl"), "term"), "asked")
    hits = _beside(index.postings, terms, [*by, "term"], "term", "qid")
    scored = hits.groupBy(*by, "qid", "doc_id").agg(F.round(F.sum(_part(k1, b)), 6).alias("score"))
    return top_k(scored, k, by)


def _rather_blocks(index: Index, queries: DataFrame) -> bool:
    """Whether the lists that the queries ask for, counted as often as they are asked for, are longer than all lists are
    once, so that reading every document once makes fewer rows than joins. Blocks take parts that are whole numbers."""
    if len(index.by) > 1 or index.by and not isinstance(index.docs.schema[index.by[0]].dataType, IntegerType):
        return False
    often = materialise(query_terms(queries).groupBy("term").agg(F.count(F.lit(1)).alias("often")), "often")
    if index.words is None:
        lists = index.terms.select("term", "df")
    else:
        lists = index.words.select(F.explode(F.array_distinct("w")).alias("term"), F.lit(1).alias("df"))
    often = F.broadcast(often) if fits_broadcast(often, 64, "term") else often
    held, asked = lists.join(often, "term", "left").agg(F.sum("df"), F.sum(F.col("df") * F.col("often"))).first()
    return (asked or 0) > (held or 0)


def search_documents(
    documents: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, by: str | None = None
) -> DataFrame:
    """The same from (doc_id, text, by) without an index and without moving a posting.

    The queries' terms and their statistics go to the documents: each task scores its documents in blocks, one dense
    accumulator a query, and sends on the ``k`` best of each query, so the shuffle holds k rows a query and block at
    most. With ``by`` statistics and rankings are those of each part. Queries are taken in passes of QUERY_TERMS terms,
    which bounds what is broadcast.
    """
    return _in_passes(*_from_words(documents, by), queries, k, k1, b, by)


def _from_words(documents: DataFrame, by: str | None, words: Column | None = None):
    """Rows, document frequencies and statistics of the parts, as ``_in_passes`` takes them, from texts or their tokens."""
    part = F.col(f"`{by}`").cast("int") if by else F.lit(0)
    words = tokens(F.col("text")) if words is None else words
    words = materialise(documents.select("doc_id", part.alias("part"), words.alias("w")).where("part is not null"), "words")
    stats = words.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))
    parts = {r["part"]: (r["n"], r["avgdl"] or 0.0) for r in stats.collect()}  # a row for each part
    rows = words.select("doc_id", "part", F.size("w").alias("dl"), "w")

    def df(wanted: DataFrame) -> DataFrame:
        found = words.select("part", F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(wanted), "term")
        return found.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"))

    return rows, df, parts


def search_index(
    index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, share: float | None = None
) -> DataFrame:
    """The same rows as ``search`` for large batches of queries, from the forward lists of a written index.

    As ``search_documents``, but nothing is cut into tokens or counted: term counts and statistics lie in the index. Of
    an index that is only planned the documents' tokens are taken. An index may be split by one column of whole numbers.
    With ``share`` each block is pruned, as in ``search_pruned``.
    """
    if len(index.by) > 1:
        return search(index, queries, k, k1, b)
    by = index.by[0] if index.by else None
    if index.words is not None:
        return _in_passes(*_from_words(index.words, by, F.col("w")), queries, k, k1, b, by, share)
    part = (F.col(by).cast("int") if by else F.lit(0)).alias("part")
    parts = {r["part"]: (r["n"], r["avgdl"] or 0.0) for r in index.stats.select(part, "n", "avgdl").where("part is not null").collect()}  # a row for each part
    rows = index.forward.select("doc_id", part, "dl", F.col("terms.term").alias("w"), F.col("terms.tf").alias("tf")).where("part is not null")

    def df(wanted: DataFrame) -> DataFrame:
        return index.terms.select(part, "term", "df").where("part is not null").join(F.broadcast(wanted), "term")

    return _in_passes(rows, df, parts, queries, k, k1, b, by, share)


def _in_passes(
    rows: DataFrame, df, parts: dict, queries: DataFrame, k: int, k1: float, b: float, by: str | None, share: float | None = None
) -> DataFrame:
    all_terms = query_terms(queries)
    passes = max(1, -(-all_terms.count() // max(1, min(QUERY_TERMS, ENTRIES // max(len(parts), 1)))))
    out = None
    for i in range(passes):
        mine = all_terms.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else all_terms
        found = _score(rows, df, mine, parts, k, k1, b, share)
        out = found if out is None else out.unionByName(found)
    best = top_k(out, k, ("part",))
    return best.select(*([F.col("part").alias(by)] if by else []), "qid", "doc_id", "score", "rank")


def _asked(spark, df, terms: DataFrame, parts: dict) -> tuple:
    """What a task needs to score: terms, their idf by part, the parts, and the queries as runs of (term, qtf)."""
    rows = terms.toPandas()  # about QUERY_TERMS rows
    names = sorted(rows["term"].unique())
    vocabulary = {t: i for i, t in enumerate(names)}
    idfs = {p: np.zeros(len(names)) for p in parts}
    for r in df(spark.createDataFrame([(t,) for t in names], "term string")).collect():  # a row for each part and query term
        idfs[r["part"]][vocabulary[r["term"]]] = np.log(1 + (parts[r["part"]][0] - r["df"] + 0.5) / (r["df"] + 0.5))
    rows = rows.sort_values("qid", kind="stable")
    qids, starts = np.unique(rows["qid"].to_numpy(object), return_index=True)
    which = np.array([vocabulary[t] for t in rows["term"]], np.int64)
    return names, idfs, parts, qids, [*starts.tolist(), len(rows)], which, rows["qtf"].to_numpy(np.float64)


def _score(words: DataFrame, df, terms: DataFrame, parts: dict, k: int, k1: float, b: float, share: float | None) -> DataFrame:
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(_asked(spark, df, terms, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idfs, parts, qids, starts, which, qtf = shared.value
        for ids, p, d, w, first in _weighted(batches, names, idfs, parts, k1, b):
            yield from _best(ids, p, d, w, first, qids, starts, which, qtf, k, share)

    kind = words.schema["doc_id"].dataType.simpleString()
    qkind = terms.schema["qid"].dataType.simpleString()
    return spread(words).mapInArrow(run, f"part int, qid {qkind}, doc_id {kind}, score double")


def _weighted(batches: Iterator[pa.RecordBatch], names: list, idfs: dict, parts: dict, k1: float, b: float) -> Iterator[tuple]:
    """For each block of documents of a part (ids, part, d, w, first): the list of term t is d and w from first[t] to
    first[t + 1], in which the documents ascend."""
    known = pa.array(names, pa.string())
    for batch in _gathered(batches, DOCUMENTS):
        of = batch.column(1).to_numpy(zero_copy_only=False)
        for p in np.unique(of):
            mine = batch.filter(pa.array(of == p))
            for at in range(0, mine.num_rows, DOCUMENTS):
                block = mine.slice(at, DOCUMENTS)
                lists = block.column(3)
                dl, size = block.column(2).to_numpy().astype(np.float64), lists.value_lengths().to_numpy()
                t = pc.index_in(lists.flatten(), value_set=known)
                t = pc.fill_null(t, -1).to_numpy(zero_copy_only=False)
                d = np.repeat(np.arange(len(dl)), size)[t >= 0]
                key = t[t >= 0].astype(np.int64) * len(dl) + d
                if block.num_columns > 4:  # counted already
                    order = np.argsort(key)
                    pairs, tf = key[order], block.column(4).flatten().to_numpy()[t >= 0][order]
                else:
                    pairs, tf = np.unique(key, return_counts=True)
                t, d = pairs // max(len(dl), 1), pairs % max(len(dl), 1)
                avgdl = parts[p][1]
                length = dl[d] / avgdl if avgdl else np.ones(len(d))
                w = idfs[p][t] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length)))
                yield block.column(0), int(p), d, w, np.searchsorted(t, np.arange(len(names) + 1))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``most`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _looked_up(docs: np.ndarray, lists: list[tuple]) -> np.ndarray:
    """The scores of some documents of a block from (documents, weights) lists, summed in the lists' order."""
    total = np.zeros(len(docs))
    for d, w in lists:
        at = np.searchsorted(d, docs)
        at[at == len(d)] = 0
        total += np.where(d[at] == docs, w[at], 0.0)
    return total


def _pruned(lists: list[tuple], size: int, k: int, share: float) -> np.ndarray | None:
    """The documents of a block that can be among its ``k`` best, all of them but few others; None where bounds rule out none.

    The terms with the highest weights in the block that make up ``share`` of the sum are scored alone. Their k-th best
    partial score is what the others' highest weights must reach.
    """
    bounds = np.array([w.max() for _, w in lists])
    order = np.argsort(-bounds, kind="stable")
    n = int(np.searchsorted(np.cumsum(bounds[order]), share * bounds.sum())) + 1
    rest = bounds[order[n:]].sum()
    if n >= len(lists):
        return None
    partial = np.bincount(np.concatenate([lists[i][0] for i in order[:n]]), np.concatenate([lists[i][1] for i in order[:n]]), minlength=size)
    if k > size:
        return None
    least = np.partition(partial, size - k)[size - k]
    if rest >= least - 1e-5:
        return None
    return np.flatnonzero(partial + rest >= least - 1e-5)


def _best(
    ids: pa.Array, part: int, d, w, first, qids, starts, which, qtf, k: int, share: float | None = None
) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of a block for each query; all of those that tie with the last, which the next step settles."""
    found_q, found_d, found_s = [], [], []
    held = 0

    def batch() -> pa.RecordBatch:
        q = np.concatenate(found_q)
        columns = [pa.array(np.full(len(q), part), pa.int32()), pa.array(qids[q].tolist())]
        columns += [ids.take(pa.array(np.concatenate(found_d))), pa.array(np.concatenate(found_s), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["part", "qid", "doc_id", "score"])

    for q in range(len(qids)):
        rows, weights = [], []
        for j in range(starts[q], starts[q + 1]):
            a, z = first[which[j]], first[which[j] + 1]
            if z > a:
                rows.append(d[a:z])
                weights.append(w[a:z] * qtf[j])
        if not rows or k <= 0:
            continue
        hit = _pruned(list(zip(rows, weights)), len(ids), k, share) if share and len(rows) > 1 else None
        if hit is not None:
            score = np.round(_looked_up(hit, list(zip(rows, weights))), 6)
            keep = score >= -np.partition(-score, k - 1)[k - 1]
            found_q.append(np.full(int(keep.sum()), q))
            found_d.append(hit[keep])
            found_s.append(score[keep])
            held += int(keep.sum())
            continue
        total = np.round(np.bincount(np.concatenate(rows), np.concatenate(weights), minlength=len(ids)), 6)
        hit = np.unique(np.concatenate(rows)) if len(ids) > 4 * sum(map(len, rows)) else np.flatnonzero(total > 0)
        if len(hit) > k:
            least = -np.partition(-total[hit], k - 1)[k - 1]
            hit = hit[total[hit] >= least]
        found_q.append(np.full(len(hit), q))
        found_d.append(hit)
        found_s.append(total[hit])
        held += len(hit)
        if held > 100_000:  # many queries with a large k
            yield batch()
            found_q, found_d, found_s, held = [], [], [], 0
    if found_q:
        yield batch()


#: Pairs whose ranks are worked out at a time, besides QUERY_TERMS.
PAIRS = 500_000


def ranks(documents: DataFrame, queries: DataFrame, pairs: DataFrame, k: int = 1000, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score, rank) of those (qid, doc_id) ``pairs`` that are among the ``k`` best of their query.

    The same rows as ``search_documents`` has for them, without sending on k rows of each query and block: the pairs'
    own scores are worked out first and go to the documents, and each block only counts how many of its documents come
    before a pair. Pairs must be distinct.
    """
    rows, df, parts = _from_words(documents, None)
    terms = materialise(query_terms(queries), "terms")
    pairs = materialise(pairs.select("qid", "doc_id"), "pairs")
    passes = max(1, -(-terms.count() // max(1, min(QUERY_TERMS, ENTRIES))), -(-pairs.count() // PAIRS))
    out = None
    for i in range(passes):
        mine = lambda t: t.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else t
        found = _ranked(rows, df, parts, mine(terms), mine(pairs), k1, b)
        out = found if out is None else out.unionByName(found)
    return out.where(F.col("rank") <= k)


def _ranked(rows: DataFrame, df, parts: dict, terms: DataFrame, pairs: DataFrame, k1: float, b: float) -> DataFrame:
    spark = rows.sparkSession
    asked = _asked(spark, df, terms, parts)
    of_qid = {q: i for i, q in enumerate(asked[3].tolist())}
    wanted = pairs.toPandas()  # PAIRS rows on average
    wanted = wanted[wanted["qid"].isin(of_qid.keys())]
    by_doc: dict = {}
    for q, doc in zip(wanted["qid"].map(of_qid).tolist(), wanted["doc_id"].tolist()):
        by_doc.setdefault(doc, []).append(q)
    shared = spark.sparkContext.broadcast((asked, by_doc))

    def lists(q: int, d, w, first, starts, which, qtf) -> list[tuple]:
        spans = ((first[which[j]], first[which[j] + 1], qtf[j]) for j in range(starts[q], starts[q + 1]))
        return [(d[a:z], w[a:z] * n) for a, z, n in spans if z > a]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, idfs, parts, _, starts, which, qtf), by_doc = shared.value
        for ids, _, d, w, first in _weighted(batches, names, idfs, parts, k1, b):
            ids = ids.to_pylist()
            here: dict[int, list[int]] = {}
            for at, doc in enumerate(ids):
                for q in by_doc.get(doc, ()):
                    here.setdefault(q, []).append(at)
            found = [(q, at, np.round(_looked_up(np.array(at), lists(q, d, w, first, starts, which, qtf)), 6)) for q, at in here.items()]
            rows = [(q, ids[x], y) for q, at, total in found for x, y in zip(at, total.tolist()) if y > 0]
            qs, docs, ys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), pa.array(docs, kinds[0]), pa.array(ys, pa.float64())], ["q", "doc_id", "score"])

    kinds = [to_arrow_type(x.schema[c].dataType) for x, c in ((rows, "doc_id"), (terms, "qid"))]
    names_ = [x.schema[c].dataType.simpleString() for x, c in ((rows, "doc_id"), (terms, "qid"))]
    there = spread(rows.join(F.broadcast(spark.createDataFrame([(x,) for x in by_doc], f"doc_id {names_[0]}")), "doc_id", "left_semi"))
    held = there.mapInArrow(scores, f"q int, doc_id {names_[0]}, score double").toPandas()
    held = held.sort_values("q", kind="stable")
    judged = spark.sparkContext.broadcast((held["q"].to_numpy(np.int64), held["doc_id"].tolist(), held["score"].to_numpy(np.float64)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, idfs, parts, qids, starts, which, qtf), _ = shared.value
        of, docs, score = judged.value
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for ids, _, d, w, first in _weighted(batches, names, idfs, parts, k1, b):
            order = sorted(range(len(ids)), key=(known := ids.to_pylist()).__getitem__)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            known.sort()
            before = np.zeros(len(docs), np.int64)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = lists(of[a], d, w, first, starts, which, qtf)
                if not own:
                    continue
                total = np.round(np.bincount(np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own]), minlength=len(order)), 6)
                for i in range(a, z):
                    before[i] = np.count_nonzero(total > score[i])
                    tied = place[total == score[i]]
                    if len(tied):
                        before[i] += np.count_nonzero(tied < bisect_left(known, docs[i]))
            columns = [pa.array(qids[of].tolist(), kinds[1]), pa.array(docs, kinds[0]), pa.array(score), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "doc_id", "score", "n"])

    each = spread(rows).mapInArrow(counts, f"qid {names_[1]}, doc_id {names_[0]}, score double, n bigint")
    return each.groupBy("qid", "doc_id", "score").agg((F.sum("n") + 1).cast("int").alias("rank"))


def search_pruned(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, share: float = 0.8) -> DataFrame:
    """The same rows as ``search``, with fewer postings read: upper bounds rule documents out before they are scored.

    For each query the terms with the highest bounds that make up ``share`` of the bounds' sum are scored first, from
    their lists alone. The k-th best of these partial scores is what a document must reach; those whose partial score and
    the other terms' bounds stay under it are dropped. The other terms of the rest are looked up in the documents'
    forward lists, not in their own lists, which are the longest. Only queries whose other terms alone could reach the
    limit are scored from all lists. Nothing that belongs to the result is lost: each part is positive and none
    exceeds its bound; the slack covers rounding. Where the lists of all queries are together longer than the index
    (``_rather_blocks``), the same is done in each block of documents, whose own highest weights are the bounds. Open a
    written index for this: one that is only planned is made anew for each step.
    """
    if _rather_blocks(index, queries):
        return search_index(index, queries, k, k1, b, share)
    by = list(index.by)
    of_query = [*by, "qid"]
    known = index.with_idf().select(*by, "term", "idf", "avgdl").join(index.bounds(k1, b), [*by, "term"])
    terms = query_terms(queries).join(known, "term").withColumn("ub", F.col("qtf") * F.col("bound"))
    by_bound = Window.partitionBy(*of_query).orderBy(F.col("ub").desc(), F.col("term"))
    before = F.coalesce(F.sum("ub").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    terms = terms.withColumn("first", before < F.lit(share) * F.sum("ub").over(Window.partitionBy(*of_query)))
    terms = materialise(terms, "asked")

    partial = _listed(index, terms.where("first"), k1, b).groupBy(*of_query, "doc_id").agg(F.sum("part").alias("partial"))
    partial = materialise(partial, "partial")
    best = Window.partitionBy(*of_query).orderBy(F.col("partial").desc(), F.col("doc_id"))
    theta = partial.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(*of_query, F.col("partial").alias("theta"))
    rest = terms.groupBy(*of_query).agg(F.coalesce(F.sum(F.when(~F.col("first"), F.col("ub"))), F.lit(0.0)).alias("rest"))
    limits = rest.join(theta, of_query, "left").withColumn("theta", F.coalesce("theta", F.lit(-1.0)))
    limits = materialise(limits.withColumn("open", F.col("rest") >= F.col("theta") - 1e-6), "limits")

    # Queries whose other terms could reach the limit by themselves: all their lists.
    again = terms.join(limits.where("open"), of_query, "left_semi")
    whole = _listed(index, again, k1, b).groupBy(*of_query, "doc_id").agg(F.sum("part").alias("total"))
    # The others: what is near the limit, and its other terms from the forward lists.
    near = _beside(partial, limits.where("not open"), of_query, "qid").where(F.col("partial") + F.col("rest") >= F.col("theta") - 1e-6)
    near = materialise(near.select(*of_query, "doc_id", "partial"), "near")
    wanted = near.select(*by, "doc_id").distinct()
    lists = index.forward.join(wanted, [*by, "doc_id"], "left_semi")
    others = terms.where("not first").select(*of_query, "term", "qtf", "idf", "avgdl")
    asked = near.join(lists, [*by, "doc_id"]).select(*of_query, "doc_id", "dl", F.explode("terms").alias("t"))
    asked = asked.select(*of_query, "doc_id", "dl", "t.term", "t.tf")
    more = _beside(asked, materialise(others, "others"), [*of_query, "term"], "qid", "term").groupBy(*of_query, "doc_id").agg(F.sum(_part(k1, b)).alias("more"))
    full = near.join(more, [*of_query, "doc_id"], "left")
    full = full.select(*of_query, "doc_id", (F.col("partial") + F.coalesce("more", F.lit(0.0))).alias("total"))
    scored = whole.select(*of_query, "doc_id", "total").unionByName(full)
    return top_k(scored.select(*of_query, "doc_id", F.round("total", 6).alias("score")), k, tuple(by))


#: Terms that are put into a filter, by which row groups are skipped; more are joined.
NAMED = 5000


def _listed(index: Index, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """(by..., qid, doc_id, part) of the lists of these query terms, only their row groups being read."""
    names = [r["term"] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
    lists = index.postings.where(F.col("term").isin(names)) if len(names) <= NAMED else index.postings
    small = materialise(terms.select(*index.by, "qid", "term", "qtf", "idf", "avgdl"), "listed")
    hits = _beside(lists, small, [*index.by, "term"], "qid", "term")
    return hits.select(*index.by, "qid", "doc_id", _part(k1, b).alias("part"))


def gather(by_shard: DataFrame, k: int) -> DataFrame:
    """One ranking for each query from the shards' own, ties by the id as a string."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").cast("string").asc())
    return by_shard.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def idf_table(index: Index) -> DataFrame:
    rows = index.terms.crossJoin(F.broadcast(index.stats)) if not index.by else index.terms.join(F.broadcast(index.stats), list(index.by))
    return rows.select(*index.by, "term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))
