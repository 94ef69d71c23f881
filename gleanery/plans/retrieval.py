"""Queries over the retrieval operators: text, index, BM25, suggestion, dense, fusion, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.engine import Engine, Settings
from gleanery.functions import scoring, text
from gleanery.operators import bm25, dense, fusion, index, metrics, suggest
from gleanery.sources import tables
from gleanery.runtime import materialise, shared_path
from gleanery.sources.text import read_run, read_tsv, run_lines, write_run, write_tsv

S, D = SparkSession, DataFrame

SCORES = ["bm25_score", "dense_score", "ce_score", "rrf_score"]
SHARDS = 4
FUNNEL = Settings()


def _index(spark: S, d: str, by: tuple[str, ...] = ()) -> index.Index:
    return index.Index.build(tables.passages(spark, d), by)


def tokenize_counts(spark: S, d: str) -> D:
    w = text.tokens(F.col("text"))
    rows = tables.passages(spark, d)
    return rows.select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_terms"))


def clean_text(spark: S, d: str) -> D:
    return tables.table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


def title_body_concat(spark: S, d: str) -> D:
    rows = tables.table(spark, d, "documents")
    return rows.select("doc_id", text.title_and_body(F.col("title"), F.col("text")).alias("full_text"))


def last_token(spark: S, d: str) -> D:
    q = F.col("query")
    fixed = text.replace_last_token(q, F.lit("X"))
    return tables.queries(spark, d).where("query is not null").select("qid", text.last_token(q).alias("last"), fixed.alias("fixed"))


def shard_assignment(spark: S, d: str) -> D:
    rows = index.with_shard(tables.passages(spark, d).drop("shard"), SHARDS)
    return rows.select("doc_id", "shard")


def doc_lengths(spark: S, d: str) -> D:
    return _index(spark, d).docs


def corpus_stats(spark: S, d: str) -> D:
    stats = _index(spark, d).stats
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def term_stats(spark: S, d: str) -> D:
    return _index(spark, d).terms.select("term", "df", "cf")


def term_bounds(spark: S, d: str) -> D:
    ix = _index(spark, d)
    bounds = ix.bounds().select("term", F.round("bound", 6).alias("bound"))
    return ix.terms.select("term", "max_tf", "min_dl").join(bounds, "term")


def vocab_frequency(spark: S, d: str) -> D:
    return suggest.vocabulary(tables.passages(spark, d))


def idf_table(spark: S, d: str) -> D:
    return bm25.idf_table(_index(spark, d))


def impacts(spark: S, d: str) -> D:
    rows = _index(spark, d).impacts()
    return rows.select("term", "doc_id", F.round("impact", 6).alias("impact"))


def bm25_single(spark: S, d: str) -> D:
    asked = spark.createDataFrame([("q", "how does the protein change the market")], "qid string, query string")
    return bm25.search(_index(spark, d), asked, 10).select("doc_id", "score", "rank")


def bm25_relational_top10(spark: S, d: str) -> D:
    return bm25.search(_index(spark, d), tables.queries(spark, d), 10)


def bm25_batch_top10(spark: S, d: str) -> D:
    return bm25.search_documents(tables.passages(spark, d), tables.queries(spark, d), 10)


def bm25_classic_params(spark: S, d: str) -> D:
    return bm25.search_documents(tables.passages(spark, d), tables.queries(spark, d), 10, 1.2, 0.75)


def bm25_wand_top10(spark: S, d: str) -> D:
    return bm25.search_pruned(_index(spark, d).stored(), tables.queries(spark, d), 10)


def index_roundtrip(spark: S, d: str) -> D:
    """Postings and statistics of an index split by shard, as read back from its files."""
    ix = _index(spark, d, ("shard",)).stored()
    terms = ix.terms.select("shard", "term", "df", "cf")
    return ix.postings.join(terms, ["shard", "term"]).join(ix.docs.select("shard", "doc_id"), ["shard", "doc_id"])


def sharded_index_bm25(spark: S, d: str) -> D:
    """Search over an index written by shard, each shard with its own statistics, then one ranking."""
    found = bm25.search_index(_index(spark, d, ("shard",)).stored(), tables.queries(spark, d), 10)
    return bm25.gather(found, 10).select("qid", "doc_id", "shard", "score", "rank")


def sharded_wand_top10(spark: S, d: str) -> D:
    found = bm25.search_pruned(_index(spark, d, ("shard",)).stored(), tables.queries(spark, d), 10)
    return bm25.gather(found, 10).select("qid", "doc_id", "shard", "score", "rank")


def sharded_bm25(spark: S, d: str) -> D:
    found = bm25.search_documents(tables.passages(spark, d), tables.queries(spark, d), 10, by="shard")
    return bm25.gather(found, 10).select("qid", "doc_id", "shard", "score", "rank")


def shard_vs_single_overlap(spark: S, d: str) -> D:
    single, sharded = bm25_batch_top10(spark, d), sharded_bm25(spark, d)
    return metrics.overlap_at_k(single, sharded, 10)


def shard_stats(spark: S, d: str) -> D:
    stats = _index(spark, d, ("shard",)).stats
    return stats.select("shard", "n", F.round("avgdl", 6).alias("avgdl"))


def posting_gaps(spark: S, d: str) -> D:
    rows = index.gaps(tables.logged_postings(spark, d), ["shard", "term"])
    return rows.select("shard", "term", "doc_id", "gap", scoring.varint_size(F.col("gap")).alias("gap_bytes"))


def posting_gaps_undone(spark: S, d: str) -> D:
    rows = index.gaps(tables.logged_postings(spark, d), ["shard", "term"]).select("shard", "term", F.col("doc_id").alias("at"), "gap")
    return index.from_gaps(rows, ["shard", "term"], "at").select("shard", "term", "doc_id")


def index_stats(spark: S, d: str) -> D:
    return index.size_report(tables.table(spark, d, "postings"))


def autocomplete(spark: S, d: str) -> D:
    return suggest.complete(vocab_frequency(spark, d), "pro", 8)


def _prefixes(spark: S, d: str) -> D:
    words = tables.queries(spark, d).select(F.explode(text.tokens(F.col("query"))).alias("w"))
    return words.where(F.length("w") >= 2).select(F.substring("w", 1, 3).alias("prefix"))


def autocomplete_batch(spark: S, d: str) -> D:
    return suggest.complete_all(vocab_frequency(spark, d), _prefixes(spark, d), 8)


def delete_variants(spark: S, d: str) -> D:
    return suggest.delete_index(vocab_frequency(spark, d), suggest.MAX_EDIT)


def _words(spark: S, d: str) -> D:
    return tables.queries(spark, d).select(F.explode(text.tokens(F.col("query"))).alias("word")).distinct()


def spell_candidates(spark: S, d: str) -> D:
    return suggest.candidates(vocab_frequency(spark, d), _words(spark, d))


def spell_topk(spark: S, d: str) -> D:
    return suggest.correct_all(vocab_frequency(spark, d), _words(spark, d), 5)


def spell_correct(spark: S, d: str) -> D:
    best = suggest.correct_all(vocab_frequency(spark, d), _words(spark, d), 1)
    return best.select("word", "term", "distance", "weight")


def query_autocorrect(spark: S, d: str) -> D:
    return suggest.correct_queries(vocab_frequency(spark, d), tables.queries(spark, d))


def spell_accuracy(spark: S, d: str) -> D:
    """Typos are made of every term of three signs or more: the third sign is left out."""
    vocab = vocab_frequency(spark, d)
    known = vocab.where("length(term) >= 3")
    typo = F.concat(F.substring("term", 1, 2), F.expr("substring(term, 4)"))
    return suggest.accuracy(vocab, known.select(typo.alias("typo"), F.col("term").alias("expected")))


def _vectors(spark: S, d: str) -> D:
    return tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def dense_knn(spark: S, d: str) -> D:
    rows = _vectors(spark, d)
    return dense.knn(rows, rows.where("id % 100 = 0"), 10)


def cosine_normalize(spark: S, d: str) -> D:
    unit = scoring.l2_normalise(F.col("v"))
    rows = _vectors(spark, d).select("id", F.round(scoring.norm(F.col("v")), 6).alias("norm"), unit.alias("u"))
    return rows.select("id", "norm", F.round(scoring.dot(F.col("u"), F.col("u")), 6).alias("unit"))


def ann_top10(spark: S, d: str) -> D:
    rows = _vectors(spark, d)
    return dense.ann(rows, rows.where("id % 100 = 0"), 10)


def ann_recall(spark: S, d: str) -> D:
    """Whether the approximate search finds 0.95 of what the exact one does, over how many queries."""
    rows = metrics.overlap_at_k(dense_knn(spark, d), ann_top10(spark, d), 10)
    return rows.agg(F.count(F.lit(1)).alias("queries"), (F.avg("overlap") >= 0.95).alias("reached"))


def encoded_queries(spark: S, d: str) -> D:
    rows = dense.embed(tables.queries(spark, d), text_col="query")
    return rows.select("qid", F.size("embedding").alias("dim"), F.round(scoring.norm(F.col("embedding")), 4).alias("norm"))


def rrf_fuse(spark: S, d: str) -> D:
    """The logged lexical and dense lists of each search, fused again."""
    rows = tables.table(spark, d, "search_results").select(F.col("search_id").alias("qid"), "doc_id", "bm25_rank", "dense_rank").distinct()
    runs = [rows.where(f"{r} is not null").select("qid", "doc_id", F.col(r).alias("rank")) for r in ("bm25_rank", "dense_rank")]
    return fusion.fuse(runs, top=10).withColumnRenamed("qid", "search_id")


def _runs(spark: S, d: str) -> list[D]:
    """The lexical and the logged list of each query, as deep as a service fetches them."""
    lexical = bm25.search_documents(tables.passages(spark, d), tables.queries(spark, d), FUNNEL.lexical_depth)
    return [lexical, tables.logged_run(spark, d, FUNNEL.dense_depth)]


def _hybrid(spark: S, d: str) -> D:
    return fusion.fuse(_runs(spark, d), FUNNEL.rrf_k)


def hybrid_top10(spark: S, d: str) -> D:
    return _hybrid(spark, d).where("rank <= 10")


def rerank_head_tail(spark: S, d: str) -> D:
    rows = tables.queries(spark, d), tables.passages(spark, d)
    found = fusion.rerank(_hybrid(spark, d), *rows, depth=FUNNEL.rerank_depth)
    return found.where("rank <= 20").select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def funnel_provenance(spark: S, d: str) -> D:
    rows = tables.queries(spark, d), tables.passages(spark, d)
    return fusion.funnel(*_runs(spark, d), *rows, FUNNEL.top_k, FUNNEL.rerank_depth, FUNNEL.rrf_k)


def _judged_run(spark: S, d: str) -> D:
    """What is graded of the runs of 1000: the ranks of the relevant passages, as no other counts."""
    relevant = metrics.judgements(tables.table(spark, d, "qrels")).where("rel > 0")
    asked = tables.queries(spark, d).join(relevant.select("qid").distinct(), "qid", "left_semi")
    return bm25.ranks(tables.passages(spark, d), asked, relevant, 1000)


def _graded(spark: S, d: str, *measures: str) -> D:
    rows = metrics.per_query(_judged_run(spark, d), tables.table(spark, d, "qrels"), measures)
    return rows.select("qid", "measure", F.round("value", 6).alias("value"))


def ndcg10(spark: S, d: str) -> D:
    return _graded(spark, d, "nDCG@10")


def rr10(spark: S, d: str) -> D:
    return _graded(spark, d, "RR@10")


def recall100(spark: S, d: str) -> D:
    return _graded(spark, d, "R@100")


def recall1000(spark: S, d: str) -> D:
    return _graded(spark, d, "R@1000")


def average_precision(spark: S, d: str) -> D:
    return _graded(spark, d, "AP")


def scorecard(spark: S, d: str) -> D:
    return metrics.scorecard(_judged_run(spark, d), tables.table(spark, d, "qrels"))


def _results(spark: S, d: str) -> D:
    return tables.table(spark, d, "search_results").distinct()


def score_ranges(spark: S, d: str) -> D:
    return fusion.score_ranges(_results(spark, d), "search_id", SCORES)


def score_bars(spark: S, d: str) -> D:
    return fusion.score_bars(_results(spark, d), "search_id", "doc_id", SCORES)


def candidate_subset(spark: S, d: str) -> D:
    """The passages that any query's first 5 logged ones name."""
    wanted = tables.logged_run(spark, d, 5).select("doc_id").distinct()
    return tables.passages(spark, d).join(wanted, "doc_id", "left_semi").select("doc_id", "text")


def trec_run_lines(spark: S, d: str) -> D:
    return run_lines(tables.logged_run(spark, d, 10), "logged")


def tsv_roundtrip(spark: S, d: str) -> D:
    """The passages as tab-separated lines, written and read back."""
    path = shared_path(spark, "tsv")
    write_tsv(tables.passages(spark, d), path)
    return read_tsv(spark, path)


def run_roundtrip(spark: S, d: str) -> D:
    """The logged run as lines of text, written and read back."""
    path = shared_path(spark, "run")
    write_run(tables.logged_run(spark, d, 10), path, "logged")
    return read_run(spark, path)


def posting_lists_roundtrip(spark: S, d: str) -> D:
    """Posting lists packed into bytes of variable-length numbers, written, and unpacked."""
    lists = materialise(index.pack_lists(tables.logged_postings(spark, d), ["shard", "term"]), "lists")
    return index.unpack_lists(lists, ["shard", "term"])


def posting_list_bytes(spark: S, d: str) -> D:
    lists = index.pack_lists(tables.logged_postings(spark, d), ["shard", "term"])
    return lists.groupBy("shard", "term").agg(F.sum("n").alias("postings"), F.sum(F.octet_length("raw")).alias("bytes"))


def index_lookup(spark: S, d: str) -> D:
    """Two terms' lists and document frequencies from a written index."""
    ix = _index(spark, d).stored()
    df = ix.df("protein").withColumn("term", F.lit("protein")).unionByName(ix.df("market").withColumn("term", F.lit("market")))
    return ix.lookup("protein", "market").select("term", "doc_id", "tf").join(df, "term")


def vocabulary_with_terms(spark: S, d: str) -> D:
    """The vocabulary with weights added for the words of the queries."""
    more = _words(spark, d).select(F.col("word").alias("term"), F.lit(5).cast("long").alias("weight"))
    return suggest.add_terms(vocab_frequency(spark, d), more)


def rerank_batched(spark: S, d: str) -> D:
    """As ``rerank_head_tail``, by a model that scores batches of pairs."""
    rows = tables.queries(spark, d), tables.passages(spark, d)
    found = fusion.rerank(_hybrid(spark, d), *rows, depth=FUNNEL.rerank_depth, scorer=fusion.batched())
    return found.where("rank <= 20").select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def embeddings_roundtrip(spark: S, d: str) -> D:
    """The queries' vectors, written and read back."""
    path = shared_path(spark, "vectors")
    dense.write_vectors(dense.embed(tables.queries(spark, d), text_col="query"), path, "qid")
    rows = dense.read_vectors(spark, path)
    return rows.select(F.col("id").alias("qid"), F.size("v").alias("dim"))


def engine_search(spark: S, d: str) -> D:
    """The first results of a service's search, with their texts."""
    found = Engine.of(tables.passages(spark, d)).search("how does the protein change the market", 10, include_text=True)
    return found.select("doc_id", "score", "rank", "text")


def engine_answer(spark: S, d: str) -> D:
    """A service's answer, from correction to re-ranking, without vectors."""
    out = Engine.of(tables.passages(spark, d), Settings(spellcheck=False)).answer("how does the protein change the market")
    return out["results"].select("doc_id", "rank", "bm25_score", "bm25_rank", F.round("ce_score", 6).alias("ce_score"), "stage")


FUNCTIONS = [
    tokenize_counts, clean_text, title_body_concat, last_token, shard_assignment, doc_lengths, corpus_stats, term_stats,
    term_bounds, vocab_frequency, idf_table, impacts, bm25_single, bm25_relational_top10, bm25_batch_top10,
    bm25_classic_params, bm25_wand_top10, index_roundtrip, sharded_index_bm25, sharded_wand_top10, sharded_bm25, shard_vs_single_overlap, shard_stats, posting_gaps,
    posting_gaps_undone, index_stats, autocomplete, autocomplete_batch, delete_variants, spell_candidates, spell_topk,
    spell_correct, query_autocorrect, spell_accuracy, dense_knn, cosine_normalize, ann_top10, ann_recall,
    encoded_queries, rrf_fuse, hybrid_top10, rerank_head_tail, funnel_provenance, ndcg10, rr10, recall100, recall1000,
    average_precision, scorecard, score_ranges, score_bars, candidate_subset, trec_run_lines,
    tsv_roundtrip, run_roundtrip, posting_lists_roundtrip, posting_list_bytes, index_lookup, vocabulary_with_terms,
    rerank_batched, embeddings_roundtrip, engine_search, engine_answer,
]
