import pytest

from gleanery import cli
from gleanery.sources import text

CORPUS = "d1\tthe quick brown fox\nd2\ta lazy dog and a fox\nd3\tmice eat cheese\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "c.tsv").write_text(CORPUS)
    (tmp_path / "q.tsv").write_text("q1\tfox\nq2\tcheese\n")
    (tmp_path / "t.tsv").write_text("chesse\tcheese\nqqqqqqqq\tfox\n")
    (tmp_path / "j.txt").write_text("q1 0 d1 1\nq2 0 d3 1\n")
    return str(tmp_path)


def test_all_commands(spark, files):
    assert cli.main(["build", "--corpus", f"{files}/c.tsv", "-o", f"{files}/ix"]) == ["3 documents, 11 terms, 12 postings"]
    runs = []
    for k, more in enumerate((["--corpus", f"{files}/c.tsv"], ["--corpus", f"{files}/c.tsv", "--wand"], ["--index", f"{files}/ix"], ["--index", f"{files}/ix", "--wand"])):
        cli.main(["batch", *more, "--queries", f"{files}/q.tsv", "--output", f"{files}/run{k}", "--tag", "t"])
        runs.append([r[0] for r in spark.read.text(f"{files}/run{k}").collect()])
    assert all(r == runs[0] for r in runs) and len(runs[0]) == 3
    assert cli.main(["batch", "--corpus", f"{files}/c.tsv", "--shards", "2", "--queries", f"{files}/q.tsv", "--output", f"{files}/s"]) == ["3 lines"]
    assert cli.main(["fuse", "--runs", f"{files}/run0", f"{files}/run1", "--output", f"{files}/f"]) == ["3 lines"]
    assert cli.main(["evaluate", "--run", f"{files}/f", "--qrels", f"{files}/j.txt", "--measures", "RR@10", "AP"]) == ["AP\t1.0000", "RR@10\t1.0000"]
    out = cli.main(["suggest", "--corpus", f"{files}/c.tsv", "--complete", "ch", "--correct", "chesse", "--eval-spell", f"{files}/t.tsv"])
    assert out == ["cheese\t1", "chesse: did you mean cheese?", "1 of 2 (50.0 %)"]


def test_arguments():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["batch", "--queries", "q", "--output", "o"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["batch", "--corpus", "c", "--index", "i", "--queries", "q", "--output", "o"])
    a = cli.parser().parse_args(["batch", "--corpus", "c", "--queries", "q", "--output", "o"])
    assert (a.top_k, a.k1, a.b, a.tag, a.wand) == (1000, 0.9, 0.4, "bm25", False)


def test_export(spark, tmp_path):
    docs = spark.createDataFrame([("b", None, "two\nlines"), ("a", "T", "x"), ("c", "", None)], "doc_id string, title string, text string")
    text.export(docs, spark.createDataFrame([("q", "w  w")], "qid string, query string"), str(tmp_path), 2)
    rows = {r["doc_id"]: r["text"] for r in text.read_tsv(spark, f"{tmp_path}/corpus.tsv").collect()}
    assert rows == {"a": "T x", "b": "two lines"} and text.slug("a/b") == "a_b"


def test_six_significant_digits(spark):
    run = spark.createDataFrame([("q", "d", 1, 12.3456789), ("q", "e", 2, 2.0)], "qid string, doc_id string, rank int, score double")
    assert [r["line"] for r in text.run_lines(run, "t", None).orderBy("rank").collect()] == ["q Q0 d 1 12.3457 t", "q Q0 e 2 2 t"]


def test_sharded_index_is_searched_by_shard(spark, files):
    cli.main(["build", "--corpus", f"{files}/c.tsv", "-o", f"{files}/sx", "--shards", "2"])
    lines = []
    for more in (["--index", f"{files}/sx"], ["--index", f"{files}/sx", "--wand"], ["--corpus", f"{files}/c.tsv", "--shards", "2"]):
        cli.main(["batch", *more, "--queries", f"{files}/q.tsv", "--output", f"{files}/o", "--tag", "t"])
        lines.append([r[0] for r in spark.read.text(f"{files}/o").collect()])
    assert lines[0] == lines[1] == lines[2] and len(lines[0]) == 3


def test_dense_rerank_and_eval(spark, files, monkeypatch):
    import io

    for kind, name in (("doc", "c"), ("query", "q")):
        cli.main(["embed", "--input", f"{files}/{name}.tsv", "--output", f"{files}/{name}v", "--kind", kind, "--batch-size", "2"])
    assert cli.main(["dense", "--documents", f"{files}/cv", "--queries", f"{files}/qv", "--output", f"{files}/dr", "--top-k", "2"]) == ["4 lines"]
    assert cli.main(["dense", "--documents", f"{files}/cv", "--queries", f"{files}/qv", "--output", f"{files}/ar", "--top-k", "2", "--approximate"]) == ["4 lines"]
    args = ["rerank", "--run", f"{files}/dr", "--corpus", f"{files}/c.tsv", "--queries", f"{files}/q.tsv", "--output", f"{files}/rr"]
    assert cli.main(args) == ["4 lines"]
    first = [r[0].split() for r in spark.read.text(f"{files}/rr").collect()]
    assert {(f[0], f[2]) for f in first if f[3] == "1" and f[0] == "q2"} == {("q2", "d3")}
    out = cli.main(["eval", "--corpus", f"{files}/c.tsv", "--queries", f"{files}/q.tsv", "--qrels", f"{files}/j.txt", "--output", f"{files}/er", "--measures", "RR@10"])
    assert out == ["3 lines", "RR@10\t1.0000"]
    monkeypatch.setattr("sys.stdin", io.StringIO("che*\n\n?chesse\nfox\n"))
    assert cli.main(["suggest", "--corpus", f"{files}/c.tsv", "--interactive"]) == ["cheese\t1", "chesse: did you mean cheese?", "fox\t2"]
    assert len(cli.main(["demo"])) == 7
