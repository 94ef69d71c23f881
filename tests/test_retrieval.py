import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine, flag, origins
from gleanery.operators import bm25, dense, fusion, index, metrics
from gleanery.operators.index import Index
from gleanery.plans import retrieval
from gleanery.sources import tables
from gleanery.streaming import append

TOY = [
    ("d1", "the quick brown fox jumps over the lazy dog"), ("d2", "a fast fox and a slow dog"), ("d3", "cats chase mice"),
    ("d4", "the dog barks at the cat"), ("d5", "mice eat cheese"), ("d6", ""), ("d7", None), ("d8", "fox fox fox"),
]
QUERIES = [("q1", "fox dog"), ("q2", "fox fox"), ("q3", "mice!"), ("q4", "zebra"), ("q5", ""), ("q6", None), ("q1", "fox dog")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TOY, "doc_id string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "qid string, query string")


def rows(run):
    return sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in run.collect())


def test_all_ways_agree(docs, asked):
    ix = Index.build(docs)
    want = rows(bm25.search(ix, asked, 3))
    assert {r[0] for r in want} == {"q1", "q2", "q3"}
    assert rows(bm25.search_documents(docs, asked, 3)) == want
    for share in (0.3, 0.8, 1.0):
        assert rows(bm25.search_pruned(ix, asked, 3, share=share)) == want
    assert rows(bm25.search_index(ix, asked, 3)) == want == rows(bm25.search_index(ix.stored(), asked, 3))
    whole = index.with_shard(docs, 1)
    assert rows(bm25.gather(bm25.search_documents(whole, asked, 3, by="shard"), 3)) == want
    assert rows(bm25.search(ix, asked, 0)) == [] == rows(bm25.search_documents(docs, asked, 0))
    assert len(rows(bm25.search_documents(docs, asked, 99))) == len(rows(bm25.search(ix, asked, 99)))


def test_passes_of_queries(docs, asked, monkeypatch):
    want = rows(bm25.search_documents(docs, asked, 3))
    monkeypatch.setattr(bm25, "QUERY_TERMS", 1)
    monkeypatch.setattr(bm25, "DOCUMENTS", 2)
    assert rows(bm25.search_documents(docs, asked, 3)) == want


@pytest.fixture(scope="module")
def many(spark):
    """1,000 documents, in which many tie and are of one length, 60 queries with common words, two shards."""
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "of", "and", f"w{rnd.randrange(6)}", f"r{rnd.randrange(90)}"])
    docs = [(f"d{i}", " ".join(word() for _ in range(rnd.choice([4, 8]))), i % 2) for i in range(1000)]
    asked = [(f"q{i}", " ".join(word() for _ in range(1 + i % 5))) for i in range(60)]
    return spark.createDataFrame(docs, "doc_id string, text string, shard int"), spark.createDataFrame(asked, "qid string, query string")


def by_joins(monkeypatch, search, *args, **more):
    with monkeypatch.context() as m:
        m.setattr(bm25, "_rather_blocks", lambda *_: False)
        return rows(search(*args, **more))


def no_joins(monkeypatch):
    """Fails where a row is made for each posting that a query asks for."""
    monkeypatch.setattr(bm25, "_beside", lambda *_: pytest.fail("a row for each posting of each query"))


def test_large_batches_are_not_joined(many, monkeypatch):
    docs, asked = many
    ix = Index.build(docs)
    want = by_joins(monkeypatch, bm25.search, ix, asked, 7)
    no_joins(monkeypatch)
    assert rows(bm25.search(ix, asked, 7)) == want and len(want) > 300


def test_large_batches_are_pruned_by_blocks(many, monkeypatch):
    docs, asked = many
    ix = Index.build(docs).stored()
    want = by_joins(monkeypatch, bm25.search_pruned, ix, asked, 7)
    no_joins(monkeypatch)
    for block, share in ((32_768, 0.8), (100, 0.8), (5, 0.5), (300, 0.3), (300, 1.0)):
        monkeypatch.setattr(bm25, "DOCUMENTS", block)
        assert rows(bm25.search_pruned(ix, asked, 7, share=share)) == want


def test_large_batches_are_pruned_by_shard(many, monkeypatch):
    docs, asked = many
    ix = Index.build(docs, ("shard",)).stored()
    of_shards = lambda *a: bm25.gather(bm25.search_pruned(*a), 7)
    want = by_joins(monkeypatch, of_shards, ix, asked, 7)
    no_joins(monkeypatch)
    assert rows(of_shards(ix, asked, 7)) == want


def test_bounds_rule_documents_out():
    import numpy as np

    every, few = np.arange(1000), np.arange(0, 1000, 50)
    lists = [(every, np.full(1000, 0.1)), (few, np.linspace(1.0, 2.0, 20))]
    assert set(bm25._pruned(lists, 1000, 3, 0.8).tolist()) == {800, 850, 900, 950}
    assert bm25._pruned(lists, 1000, 30, 0.8) is None  # fewer than k have the rare term
    assert bm25._looked_up(np.array([50, 51]), lists).round(3).tolist() == [1.153, 0.1]


def test_ranks_without_runs(many, monkeypatch):
    docs, asked = many
    run = bm25.search_documents(docs, asked, 200)
    pairs = run.select("qid", "doc_id").where("rank % 3 = 0 or rank > 190").union(asked.select("qid", F.lit("nowhere")))
    for k, block, pass_ in ((150, 32_768, 500_000), (195, 40, 500_000), (150, 90, 20)):
        monkeypatch.setattr(bm25, "DOCUMENTS", block)
        monkeypatch.setattr(bm25, "QUERY_TERMS", pass_)
        want = rows(run.where(F.col("rank") <= k).join(pairs, ["qid", "doc_id"], "left_semi"))
        assert rows(bm25.ranks(docs, asked, pairs, k)) == want and len(want) > 500
    monkeypatch.setattr(bm25, "PAIRS", 100)
    assert rows(bm25.ranks(docs, asked, pairs, 150)) == rows(run.where("rank <= 150").join(pairs, ["qid", "doc_id"], "left_semi"))
    assert rows(bm25.ranks(docs, asked, pairs.limit(0), 150)) == [] == rows(bm25.ranks(docs.limit(0), asked, pairs, 150))


@pytest.mark.parametrize("name", ["scorecard", "ndcg10", "recall100", "recall1000", "rr10", "average_precision"])
def test_grades_without_runs(spark, monkeypatch, name):
    """No grade needs the first 1000 of each query; that they are right is held against SQL."""
    monkeypatch.setattr(bm25, "_best", None)
    monkeypatch.setattr(bm25, "search_documents", lambda *_: pytest.fail("runs of 1000 are sent on"))
    assert getattr(retrieval, name)(spark, "/root/testdata/sf0.001").count()


def test_a_repeated_query_term_counts_again(docs, asked):
    once = {r["doc_id"]: r["score"] for r in bm25.search(Index.build(docs), asked.where("qid = 'q2'"), 9).collect()}
    single = asked.sparkSession.createDataFrame([("q2", "fox")], "qid string, query string")
    for r in bm25.search(Index.build(docs), single, 9).collect():
        assert abs(once[r["doc_id"]] - 2 * r["score"]) < 1e-5


def test_empty_index(docs, asked):
    none = docs.limit(0)
    assert rows(bm25.search_index(Index.build(none), asked)) == []
    assert rows(bm25.search_documents(none, asked)) == [] == rows(bm25.search(Index.build(none), asked))
    assert Index.build(none).stats.first()["avgdl"] == 0.0


def test_index_on_disk(spark, docs, asked, tmp_path):
    ix = Index.build(index.with_shard(docs, 3), ("shard",))
    ix.write(str(tmp_path / "ix"))
    back = Index.open(spark, str(tmp_path / "ix"), ("shard",))
    assert rows(bm25.gather(bm25.search(back, asked, 5), 5)) == rows(bm25.gather(bm25.search(ix, asked, 5), 5))
    assert back.lookup("fox").count() == 3 and back.docs.count() == 8
    assert Index.open(spark, str(tmp_path / "ix")).by == ("shard",)
    with pytest.raises(ValueError):
        Index.open(spark, str(tmp_path / "ix"), ())
    docs.write.parquet(str(tmp_path / "no/postings"))
    for name in ("docs", "terms", "stats"):
        docs.write.parquet(str(tmp_path / f"no/{name}"))
    with pytest.raises(ValueError):
        Index.open(spark, str(tmp_path / "no"))


def test_gaps_round_trip(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 9, 2), ("b", 0, 1)], "term string, doc_id int, tf int")
    gapped = index.gaps(df, ["term"])
    assert sorted((r["term"], r["gap"]) for r in gapped.collect()) == [("a", 3), ("a", 6), ("b", 0)]
    back = index.from_gaps(gapped.withColumnRenamed("doc_id", "pos"), ["term"], "pos")
    assert sorted(r["doc_id"] for r in back.collect()) == [0, 3, 9]


def test_long_lists_are_cut_and_joined(spark):
    rows_ = [("hot", i, 1) for i in range(0, 4000, 3)] + [(f"t{i}", i % 7, 2) for i in range(60)]
    df = spark.createDataFrame(rows_, "term string, doc_id int, tf int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        gapped = index.gaps(df, ["term"])
        assert sorted(r["gap"] for r in gapped.where("term = 'hot'").collect()) == [0] + [3] * 1333
        back = index.from_gaps(gapped.withColumnRenamed("doc_id", "pos"), ["term"], "pos")
        assert back.where("doc_id <> pos").isEmpty() and back.count() == len(rows_)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packed_lists(spark, monkeypatch):
    rows_ = [(None, "a", 5, 2), (0, "a", 0, 1), (0, "a", 300, 7), (0, "b", 70_000, 1), (1, "a", 4_000_000_000, 1)]
    df = spark.createDataFrame(rows_, "shard int, term string, doc_id bigint, tf int")
    for span in (1 << 20, 100):
        monkeypatch.setattr(index, "SPAN", span)
        back = index.unpack_lists(index.pack_lists(df, ["shard", "term"]), ["shard", "term"])
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows_, key=repr)
    assert index.pack_lists(df.limit(0), ["shard", "term"]).collect() == []


def test_pruned_search_reads_fewer_postings(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    texts = [(f"d{i}", " ".join(["the of and in"] * 3 + [rnd.choice(["rare", "seldom", "few"]) + str(rnd.randrange(40)) for _ in range(5)])) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    asked = spark.createDataFrame([("q1", "the rare3 of few7"), ("q2", "in the seldom5 and rare1")], "qid string, query string")
    ix = Index.build(docs).stored()
    read = []
    listed = bm25._listed

    def counted(index_, terms, k1, b):
        names = [r["term"] for r in terms.select("term").distinct().collect()]
        read.append(index_.postings.where(F.col("term").isin(names)).count())
        return listed(index_, terms, k1, b)

    monkeypatch.setattr(bm25, "_listed", counted)
    assert rows(bm25.search_pruned(ix, asked, 3)) == rows(bm25.search(ix, asked, 3))
    full = ix.lookup("the", "of", "in", "and", "rare3", "few7", "seldom5", "rare1").count()
    assert sum(read) < 0.2 * full


def test_a_failing_scorer_leaves_the_fused_order(docs):
    def broken():
        def score(pairs):
            raise RuntimeError("no model")

        return score

    out = Engine.of(docs).answer("fox dog", scorer=fusion.batched(broken))
    assert not out["pipeline"]["rerank"] and "rerank_error" in out["pipeline"]
    assert [r["stage"] for r in out["results"].collect()] == ["lexical"] * 4
    assert Engine.of(docs).answer("fox dog", scorer=fusion.batched())["pipeline"]["rerank"]


def test_vectors_on_disk(spark, docs, tmp_path):
    path = str(tmp_path / "v")
    dense.write_vectors(dense.embed(docs, batch=2, max_length=1), path)
    back = {r["id"]: r["v"] for r in dense.read_vectors(spark, path).collect()}
    assert len(back) == 8 and back["d2"] != back["d8"] and sum(x != 0 for x in back["d2"]) == 1
    docs.write.parquet(str(tmp_path / "no"))
    with pytest.raises(ValueError):
        dense.read_vectors(spark, str(tmp_path / "no"))


def test_approximate_search_finds_most(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    v = centers[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    some = df.where("id % 10 = 0")
    exact, near = dense.knn(df, some, 5, 16), dense.ann(df, some, 5, 16)
    assert metrics.overlap_at_k(exact, near, 5).agg(F.avg("overlap")).first()[0] >= 0.95
    # Collections in groups need few cells.
    assert dense._probes(v / np.linalg.norm(v, axis=1)[:, None], centers / np.linalg.norm(centers, axis=1)[:, None], 5, 0.99, rng) < 10


def test_fusion(spark):
    run = lambda ids, q="q": spark.createDataFrame([(q, d, i + 1) for i, d in enumerate(ids)], "qid string, doc_id string, rank int")
    got = fusion.fuse([run("abc"), run("bd")]).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["b", "a", "d", "c"]
    assert [r["doc_id"] for r in fusion.fuse([run("cab")]).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r["doc_id"] for r in fusion.fuse([run("x"), run("a")]).orderBy("rank").collect()] == ["x", "a"]  # the first run wins ties
    assert {r["qid"] for r in fusion.fuse([run("a"), run("b", "p")]).collect()} == {"q", "p"}


def test_rerank(spark, docs):
    run = spark.createDataFrame([("q", d, 10.0 - i, i + 1) for i, d in enumerate(["d3", "d1", "gone", "d5", "d2"])] + [("other", "d3", 7.0, 1)], "qid string, doc_id string, score double, rank int")
    asked = spark.createDataFrame([("q", "fox dog")], "qid string, query string")
    got = fusion.rerank(run, asked, docs, depth=3).orderBy("qid", "rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got if r["qid"] == "q"] == [("d1", 1.0), ("d3", 0.0), ("d5", -1.0), ("d2", -2.0)]
    assert [(r["doc_id"], r["score"]) for r in got if r["qid"] == "other"] == [("d3", 7.0)]
    kept = fusion.rerank(run, asked, docs, depth=3, drop_missing=False).where("qid = 'q'").orderBy("rank").collect()
    assert [r["doc_id"] for r in kept] == ["d1", "d3", "gone", "d5", "d2"]


def test_funnel(spark, docs, asked):
    lexical = bm25.search_documents(docs, asked, 5)
    only = fusion.funnel(lexical, None, asked, docs, scorer=None).collect()
    assert {r["stage"] for r in only} == {"lexical"} and all(r["rrf_score"] > 0 for r in only)
    both = fusion.funnel(lexical, lexical, asked, docs, depth=1).collect()
    assert {r["stage"] for r in both} == {"reranked", "hybrid"}


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "b", 0), ("q", "z", None), ("p", "a", 1), ("n", "a", 0)], "qid string, doc_id string, relevance int")
    run = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "qid string, doc_id string, rank int")
    got = {(r["qid"], r["measure"]): r["value"] for r in metrics.per_query(run, qrels).collect()}
    assert got["q", "RR@10"] == 0.5 and got["q", "R@100"] == 1.0
    assert abs(got["q", "AP"] - (1 / 2 + 2 / 3) / 2) < 1e-12
    assert abs(got["q", "nDCG@10"] - (2 / 1.584962500721156 + 0.5) / (2 + 1 / 1.584962500721156)) < 1e-9
    assert got["p", "AP"] == got["n", "nDCG@10"] == 0.0
    card = {r["measure"]: r["value"] for r in metrics.scorecard(run, qrels).collect()}
    assert card["RR@10"] == round(0.5 / 3, 4)
    assert metrics.parse("nDCG@10") == ("nDCG", 10) and metrics.parse("AP") == ("AP", None)
    for bad in ("AP@3", "RR", "F1@2"):
        with pytest.raises(ValueError):
            metrics.parse(bad)


def test_dense(spark):
    rows_ = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("s", [1.0]), ("n", None), ("x", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows_, "id string, v array<double>")
    one = df.where("id = 'a'")
    assert [r["doc_id"] for r in dense.knn(df, one, 3, 2).orderBy("rank").collect()] == ["a", "c", "b"]
    assert [r["doc_id"] for r in dense.ann(df, one, 3, 2, cells=3, probes=3).orderBy("rank").collect()] == ["a", "c", "b"]
    assert dense.knn(df, one.limit(0), 3, 2).collect() == []
    assert dense.instruction("query", "x/bge-small") and not dense.instruction("document", "x/bge-small") and not dense.instruction("query", "e5")
    assert dense.embed(spark.createDataFrame([("a b a",), (None,)], "text string")).select(F.size("embedding").alias("n")).first()["n"] == 64


def test_engine(spark, docs):
    e = Engine.of(docs)
    assert [r["doc_id"] for r in e.search("fox", include_text=True).collect()][0] == "d8"
    assert e.autocomplete("mi").first()["term"] == "mice"
    assert e.correct("chesse")["term"] == "cheese" and e.correct("qqqqqqq") == {"found": False, "alternatives": []}
    assert e.health()["num_docs"] == 8 and e.health()["suggest_ready"]
    out = e.answer("chesse mice")
    assert out["corrected_query"] == "cheese mice" and out["results"].first()["doc_id"] == "d5"
    assert flag("yes") and not flag("0") and flag(None, True) and origins("a, b,") == ["a", "b"]


def test_streaming(spark, docs, asked, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ix")
    docs.limit(4).coalesce(1).write.parquet(source)
    go = lambda: append.append(spark.readStream.schema(docs.schema).parquet(source), path, str(tmp_path / "cp")).awaitTermination()
    go()
    docs.coalesce(1).write.mode("append").parquet(source)
    go()
    got = append.current(spark, path)
    assert got.docs.count() == 8 and rows(bm25.search(got, asked, 3)) == rows(bm25.search_documents(docs, asked, 3))


def test_registered_funnel_is_as_deep_as_a_service(spark):
    d = "/root/testdata/sf0.001"
    asked, texts = tables.queries(spark, d), tables.passages(spark, d)
    fused = {}
    for run in (bm25.search(Index.build(texts), asked, 200), tables.logged_run(spark, d, 200)):
        for r in run.collect():
            fused.setdefault(r["qid"], {}).setdefault(r["doc_id"], []).append(r["rank"])
    want = {q: sorted((round(sum(1 / (60 + r) for r in ranks), 9) for ranks in of.values()), reverse=True)[:10] for q, of in fused.items()}
    got = {}
    for r in retrieval.hybrid_top10(spark, d).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["score"])
    assert {q: pytest.approx(s, abs=2e-9) for q, s in want.items()} == got
    found = retrieval.funnel_provenance(spark, d).agg(F.max("bm25_rank"), F.max("rrf_rank")).first()
    assert found[0] > 10 and 20 < found[1] <= 50
    assert retrieval.rerank_head_tail(spark, d).where("score < 0").isEmpty()


@pytest.mark.parametrize("fits", [True, False])
def test_impacts_by_shard(docs, monkeypatch, fits):
    monkeypatch.setattr(index, "fits_broadcast", lambda *a: fits)
    ix = Index.build(index.with_shard(docs, 2), ("shard",))
    got = {(r["shard"], r["term"], r["doc_id"]): r["impact"] for r in ix.impacts().collect()}
    bounds = {(r["shard"], r["term"]): r["bound"] for r in ix.bounds().collect()}
    assert len(got) == ix.postings.count() and all(0 < v <= bounds[s, t] + 1e-12 for (s, t, _), v in got.items())
