import random

import pytest

from gleanery.operators import skew

SCHEMA = "shard int, term string, doc_id int, n int, first string"


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_equals_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice([0, 1, None]), rnd.choice(["the"] * 9 + ["a", "b", "", None]), rnd.choice([None, *range(200)]), 1, "x") for _ in range(3000)]
    rows += [(0, "the", 7, 1, "x")] * 2000  # one pair many times
    want = {}
    for s, t, d, *_ in rows:
        if d is not None:
            want.setdefault((s, t), set()).add(d)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = skew.distinct_per_key(df, ["shard", "term"], "doc_id", partitions).collect()
    assert len(out) == len(want) and {(r["shard"], r["term"]): r["n"] for r in out} == {k: len(v) for k, v in want.items()}


def test_strings_and_no_rows(spark):
    df = spark.createDataFrame([("k", "x"), ("k", "y"), ("k", "y"), ("l", None)], "k string, m string")
    assert [tuple(r) for r in skew.distinct_per_key(df, ["k"], "m").collect()] == [("k", 2)]
    assert skew.distinct_per_key(df.limit(0), ["k"], "m").collect() == []


def test_mismatches(spark):
    rows = spark.createDataFrame([(0, "a", 1, 1, ""), (0, "a", 2, 1, ""), (0, "b", 1, 1, ""), (None, "c", 1, 1, ""), (0, "d", 1, 1, "")], SCHEMA)
    entries = spark.createDataFrame([(0, "a", 2), (0, "a", 2), (0, "b", 3), (None, "c", 1), (0, "e", 4), (0, "f", None), (0, "d", None)], "shard int, term string, df int")
    out = skew.count_mismatches(rows, entries, ["shard", "term"], "doc_id", "df").collect()
    assert {(r["shard"], r["term"], r["n"], r["recorded"]) for r in out} == {(0, "b", 1, 3), (0, "e", 0, 4), (0, "d", 1, 0)}
    assert skew.count_mismatches(rows.limit(0), entries.limit(0), ["shard", "term"], "doc_id", "df").collect() == []
