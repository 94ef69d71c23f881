import random

import pytest

from gleanery.llm import topn

SCHEMA = "shard int, qid string, external_id string, score double, rank int, item string"


def brute(rows, n):
    best = {}
    for shard, qid, item, score, *_ in rows:
        if item and score is not None and abs(score) != float("inf") and score == score:
            g = best.setdefault((shard, qid), {})
            g[item] = max(score, g.get(item, score))
    return sorted(((*g, i) for g, x in best.items() for i, _ in sorted(x.items(), key=lambda p: (-p[1], p[0]))[:n]), key=repr)


@pytest.mark.parametrize("subgroup", [20, 200_000])
@pytest.mark.parametrize("fits", [True, False])
def test_equals_brute_force(spark, subgroup, fits, monkeypatch):
    monkeypatch.setattr(topn, "fits_broadcast", lambda *a: fits)
    rnd = random.Random(3)
    scores = [1.0, 2.0, 2.0, 3.5, None, float("nan"), float("inf"), float("-inf"), -1.0]
    rows = [
        (rnd.choice([0, 1, None]), rnd.choice(["q0"] * 8 + ["q1", "q2", None]), rnd.choice([f"d{i}" for i in range(90)] + ["", None]), rnd.choice(scores), 1, "x")
        for _ in range(900)
    ]
    rows += rows[:50]
    out = topn.top_n(spark.createDataFrame(rows, SCHEMA), ["shard", "qid"], "external_id", "score", 10, subgroup)
    got = sorted(((r["shard"], r["qid"], r["external_id"]) for r in out.collect()), key=repr)
    assert got == brute(rows, 10)
    assert {r["rank"] for r in out.collect()} == set(range(1, 11))


def test_empty(spark):
    assert topn.top_n(spark.createDataFrame([], SCHEMA), ["shard", "qid"], "external_id", "score").collect() == []
