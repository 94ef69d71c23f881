import pytest
from pyspark.sql import functions as F

from gleanery.functions import scoring, text
from gleanery.sources import text as files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,want",
    [(None, []), ("", []), ("Ab-1 c", ["ab", "1", "c"]), ("Kelvin café", ["elvin", "caf"]), ("a_b", ["a", "b"])],
)
def test_tokens(spark, given, want):
    assert one(spark, text.tokens(F.col("t").cast("string")), t=given) == want


@pytest.mark.parametrize("value,size", [(0, 1), (1, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), (268435455, 4), (268435456, 5), (4294967295, 5)])
def test_varint_size(spark, value, size):
    assert one(spark, scoring.varint_size(F.col("v")), v=value) == size


def test_deletes(spark):
    assert set(one(spark, text.deletes(F.col("w"), 2), w="abc")) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    assert one(spark, text.deletes(F.col("w"), 2), w="a") == ["a"]


def test_clean_and_last_token(spark):
    assert one(spark, text.clean(F.col("t")), t="  a \t b\r\n　c ") == "a b c"
    assert one(spark, text.last_token(F.col("q")), q="Big HOUSE") == "house"
    assert one(spark, text.last_token(F.col("q")), q="big h") is None
    assert one(spark, text.replace_last_token(F.col("q"), F.lit("horse")), q="big hor") == "big horse"


@pytest.mark.parametrize("v,low,high,want", [(None, 0.0, 1.0, 0.0), (float("nan"), 0.0, 1.0, 0.0), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 1.0, 0.04), (0.5, 0.0, 1.0, 0.5)])
def test_bars(spark, v, low, high, want):
    assert one(spark, scoring.bar(F.col("v").cast("double"), F.col("a"), F.col("b")), v=v, a=low, b=high) == want


def test_idf_is_positive_and_empty_index(spark):
    assert one(spark, scoring.idf(F.col("n"), F.col("df")), n=10, df=10) > 0
    assert one(spark, scoring.bm25_weight(F.lit(1), F.lit(0), F.lit(0.0))) == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_bytes(b'd1\tone\ttwo "x"\r\n\tno id\nno tab\nd2\t\nd3\tthree\n')
    rows = {r["doc_id"]: r["text"] for r in files.read_tsv(spark, str(tmp_path / "c.tsv")).collect()}
    assert rows == {"d1": 'one\ttwo "x"', "d2": "", "d3": "three"}
    files.write_tsv(files.read_tsv(spark, str(tmp_path / "c.tsv")), str(tmp_path / "out"))
    again = {r["doc_id"]: r["text"] for r in files.read_tsv(spark, str(tmp_path / "out")).collect()}
    assert again == {"d1": 'one two "x"', "d2": "", "d3": "three"}


def test_runs(spark, tmp_path):
    run = spark.createDataFrame([("q", "a", 1, 2.5), ("q", "b", 2, 1.0), ("p", "c", 1, 1 / 3)], "qid string, doc_id string, rank int, score double")
    files.write_run(run, str(tmp_path / "run"), "t")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "run")).collect()]
    assert lines == ["p Q0 c 1 0.333333 t", "q Q0 a 1 2.500000 t", "q Q0 b 2 1.000000 t"]
    (tmp_path / "r.txt").write_text("q Q0 a 1 1.0 t\nq Q0 b 2 3.0 t\nshort line\nq Q0 c 3 3.0 t\n")
    got = [(r["doc_id"], r["rank"]) for r in files.read_run(spark, str(tmp_path / "r.txt")).orderBy("rank").collect()]
    assert got == [("b", 1), ("c", 2), ("a", 3)]
