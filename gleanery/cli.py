"""Command line: build, batch, embed, dense, fuse, rerank, suggest, evaluate, eval and demo over text files. Run ``python -m gleanery.cli -h``."""

from __future__ import annotations

import argparse
import functools
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.operators import bm25, dense, fusion, metrics, suggest
from gleanery.operators.index import Index, with_shard
from gleanery.runtime import ship
from gleanery.sources import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanery")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a collection")
    b.add_argument("--corpus", required=True)
    b.add_argument("--output", "-o", required=True)
    b.add_argument("--shards", type=int, default=1)
    s = sub.add_parser("batch", help="rank documents for queries")
    one = s.add_mutually_exclusive_group(required=True)
    one.add_argument("--corpus")
    one.add_argument("--index")
    s.add_argument("--queries", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--top-k", type=int, default=1000)
    s.add_argument("--per-shard-k", type=int, default=0)
    s.add_argument("--shards", type=int, default=1)
    s.add_argument("--k1", type=float, default=0.9)
    s.add_argument("--b", type=float, default=0.4)
    s.add_argument("--tag", default="bm25")
    s.add_argument("--wand", action="store_true")
    f = sub.add_parser("fuse", help="fuse runs by reciprocal rank")
    f.add_argument("--runs", nargs="+", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--k", type=int, default=60)
    f.add_argument("--top-k", type=int, default=1000)
    g = sub.add_parser("suggest", help="complete or correct")
    g.add_argument("--corpus", required=True)
    g.add_argument("--complete")
    g.add_argument("--correct")
    g.add_argument("--eval-spell")
    g.add_argument("--interactive", action="store_true", help="answer lines of the standard input")
    g.add_argument("--top-k", type=int, default=8)
    g.add_argument("--max-edit", type=int, default=2)
    e = sub.add_parser("evaluate", help="grade a run; judgements are lines: qid, 0, document, relevance")
    e.add_argument("--run", required=True)
    e.add_argument("--qrels", required=True)
    e.add_argument("--measures", nargs="+", default=list(metrics.MEASURES))
    v = sub.add_parser("embed", help="encode a collection or queries by the stand-in encoder")
    v.add_argument("--input", required=True)
    v.add_argument("--output", required=True)
    v.add_argument("--kind", choices=["doc", "query"], default="doc")
    v.add_argument("--model", default="hashing")
    v.add_argument("--dim", type=int, default=64)
    v.add_argument("--batch-size", type=int, default=256)
    v.add_argument("--max-length", type=int)
    d = sub.add_parser("dense", help="rank encoded documents for encoded queries")
    d.add_argument("--documents", required=True)
    d.add_argument("--queries", required=True)
    d.add_argument("--output", required=True)
    d.add_argument("--dim", type=int, default=64)
    d.add_argument("--top-k", type=int, default=1000)
    d.add_argument("--approximate", action="store_true")
    r = sub.add_parser("rerank", help="order the head of a run by the stand-in scorer")
    r.add_argument("--run", required=True)
    r.add_argument("--corpus", required=True)
    r.add_argument("--queries", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--depth", type=int, default=100)
    r.add_argument("--batch-size", type=int, default=64)
    r.add_argument("--max-length", type=int, default=512)
    w = sub.add_parser("eval", help="rank, write the run and grade it in one go")
    for name in ("corpus", "queries", "qrels", "output"):
        w.add_argument(f"--{name}", required=True)
    w.add_argument("--top-k", type=int, default=1000)
    w.add_argument("--k1", type=float, default=0.9)
    w.add_argument("--b", type=float, default=0.4)
    w.add_argument("--measures", nargs="+", default=list(metrics.MEASURES))
    x = sub.add_parser("demo", help="a few texts, a few queries")
    x.add_argument("--top-k", type=int, default=3)
    return p


def main(args: list[str] | None = None) -> list[str]:
    """Runs a command; returns the lines it printed."""
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("gleanery").getOrCreate()
    ship(spark)
    lines = globals()[f"_{a.command}"](spark, a)
    print("\n".join(lines))
    return lines


def _corpus(spark, path):
    return text.unique(text.read_tsv(spark, path))


def _build(spark, a) -> list[str]:
    rows = _corpus(spark, a.corpus)
    by = ("shard",) if a.shards > 1 else ()
    ix = Index.build(with_shard(rows, a.shards) if by else rows, by)
    ix.write(a.output)
    n = Index.open(spark, a.output, by)
    return [f"{n.docs.count()} documents, {n.terms.count()} terms, {n.postings.count()} postings"]


def _batch(spark, a) -> list[str]:
    queries = text.read_tsv(spark, a.queries, "qid", "query")
    if a.index:
        search = bm25.search_pruned if a.wand else bm25.search_index
        ix = Index.open(spark, a.index)
        run = search(ix, queries, (a.per_shard_k or a.top_k) if ix.by else a.top_k, a.k1, a.b)
        run = bm25.gather(run, a.top_k) if ix.by else run
    elif a.shards > 1:
        rows = with_shard(_corpus(spark, a.corpus), a.shards)
        leaf = bm25.search_documents(rows, queries, a.per_shard_k or a.top_k, a.k1, a.b, by="shard")
        run = bm25.gather(leaf, a.top_k)
    elif a.wand:
        run = bm25.search_pruned(Index.build(_corpus(spark, a.corpus)).stored(), queries, a.top_k, a.k1, a.b)
    else:
        run = bm25.search_documents(_corpus(spark, a.corpus), queries, a.top_k, a.k1, a.b)
    text.write_run(run, a.output, a.tag)
    return [f"{spark.read.text(a.output).count()} lines"]


def _fuse(spark, a) -> list[str]:
    text.write_run(fusion.fuse([text.read_run(spark, r) for r in a.runs], a.k, a.top_k), a.output, "rrf")
    return [f"{spark.read.text(a.output).count()} lines"]


def _suggest(spark, a) -> list[str]:
    vocab = suggest.vocabulary(_corpus(spark, a.corpus)).persist()
    out = []
    if a.complete is not None:
        out += [f"{r['term']}\t{r['weight']}" for r in suggest.complete(vocab, a.complete, a.top_k).collect()]
    if a.correct is not None:
        rows = suggest.correct_all(vocab, spark.createDataFrame([(a.correct,)], "word string"), a.top_k, a.max_edit)
        out.append(suggest.message(a.correct, [(r["term"], r["distance"]) for r in rows.orderBy("rank").collect()]))
    if a.eval_spell:
        r = suggest.accuracy(vocab, text.read_tsv(spark, a.eval_spell, "typo", "expected"), a.max_edit).first()
        out.append(f"{r['correct']} of {r['pairs']} ({r['percent']:.1f} %)")
    for line in sys.stdin if a.interactive else ():
        if line.strip():
            out += _answer(vocab, line, a.top_k, a.max_edit)
    return out


def _answer(vocab, line: str, k: int, max_edit: int) -> list[str]:
    """What an interactive line gets: terms of a prefix, or what a word was meant to be."""
    known = lambda w: not vocab.where(F.col("term") == w).isEmpty()
    kind, word = suggest.intent(line, known)
    if kind == "complete":
        return [f"{r['term']}\t{r['weight']}" for r in suggest.complete(vocab, word, k).collect()]
    rows = suggest.correct_all(vocab, vocab.sparkSession.createDataFrame([(word,)], "word string"), k, max_edit)
    return [suggest.message(word, [(r["term"], r["distance"]) for r in rows.orderBy("rank").collect()])]


def _embed(spark, a) -> list[str]:
    rows = text.unique(text.read_tsv(spark, a.input))
    load = functools.partial(dense.hashing_encoder, a.dim)
    made = dense.embed(rows, load, instruction=dense.instruction(a.kind, a.model), batch=a.batch_size, max_length=a.max_length)
    dense.write_vectors(made, a.output)
    return [f"{dense.read_vectors(spark, a.output).count()} vectors"]


def _dense(spark, a) -> list[str]:
    search = dense.ann if a.approximate else dense.knn
    run = search(dense.read_vectors(spark, a.documents), dense.read_vectors(spark, a.queries), a.top_k, a.dim, decimals=6)
    text.write_run(run, a.output, "dense")
    return [f"{spark.read.text(a.output).count()} lines"]


def _rerank(spark, a) -> list[str]:
    queries = text.read_tsv(spark, a.queries, "qid", "query")
    scorer = fusion.batched(batch=a.batch_size, max_length=a.max_length)
    run = fusion.rerank(text.read_run(spark, a.run), queries, _corpus(spark, a.corpus), a.depth, scorer)
    text.write_run(run, a.output, "rerank")
    return [f"{spark.read.text(a.output).count()} lines"]


def _eval(spark, a) -> list[str]:
    run = bm25.search_documents(_corpus(spark, a.corpus), text.read_tsv(spark, a.queries, "qid", "query"), a.top_k, a.k1, a.b)
    text.write_run(run, a.output, "bm25")
    a.run = a.output
    return [f"{spark.read.text(a.output).count()} lines", *_evaluate(spark, a)]


def _demo(spark, a) -> list[str]:
    said = ["a heron waits by the river", "the river froze in winter", "winter markets sell warm bread", "bread rises while the baker waits"]
    documents = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(said)], "doc_id string, text string")
    queries = spark.createDataFrame([(q, q) for q in ("river winter", "warm bread", "waits")], "qid string, query string")
    rows = bm25.search_documents(documents, queries, a.top_k).orderBy("qid", "rank").collect()
    return [f"{r['qid']}\t{r['rank']}\t{r['doc_id']}\t{r['score']:.4f}" for r in rows]


def _evaluate(spark, a) -> list[str]:
    f = F.split(F.trim("value"), r"\s+")
    judged = spark.read.text(a.qrels).select(f.alias("f")).where(F.size("f") >= 4)
    qrels = judged.select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].try_cast("int").alias("relevance"))
    rows = metrics.scorecard(text.read_run(spark, a.run), qrels, tuple(a.measures)).collect()
    return [f"{r['measure']}\t{r['value']:.4f}" for r in rows]


if __name__ == "__main__":
    main()
