import random
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import packing


def check(histogram, capacity):
    table, total = packing.plan(histogram, capacity)
    load, seen = np.zeros(total, np.int64), Counter()
    for length, first, last, container in table.itertuples(index=False):
        load[container : container + last - first + 1] += length
        seen[length] += last - first + 1
    assert seen == Counter({k: v for k, v in histogram.items() if 0 < k <= capacity and v})
    assert load.max(initial=0) <= capacity and (load > 0).all()
    for _, g in table.groupby("length"):
        g = g.sort_values("first")
        assert g["first"].iloc[0] == 0 and (g["first"].to_numpy()[1:] == g["last"].to_numpy()[:-1] + 1).all()
    return load.sum(), total


@pytest.mark.parametrize("seed", range(60))
def test_any_histogram_is_packed(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 100, 2048])
    histogram = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 300)))
    check(histogram, capacity)


def test_little_room_is_lost_and_size_does_not_matter():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.5, 0.9, 20_000).astype(int) + 1, 2048)
    base = Counter(lengths.tolist())
    for times in (1, 10_000):
        tokens, total = check({k: v * times for k, v in base.items()}, 2048)
        assert tokens / (total * 2048) > 0.99


def test_patterns_do_the_bulk():
    shapes = packing.patterns(np.array([40, 24, 12, 8]), 64)
    assert (shapes @ np.array([40, 24, 12, 8]) == 64).all() and len(shapes) > 3
    a = shapes.T
    want = a @ np.arange(1, len(shapes) + 1, dtype=float)
    x = packing.nnls(a, want)
    assert (x >= 0).all() and np.allclose(a @ x, want)


def test_empty():
    assert packing.plan({})[1] == 0


def pack(spark, rows, capacity=10):
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, piece string, container string")
    return packing.pack(df, capacity).collect()


def test_pieces(spark):
    rows = [(1, 25, "x", "y"), (2, None, "x", "y"), (3, 0, "x", "y"), (4, 10, "x", "y"), (5, 4, "x", "y"), (5, 4, "x", "y"), (None, 6, "x", "y")]
    out = pack(spark, rows)
    assert len(out) == 9  # three pieces of the first
    first = sorted((r["piece"], r["n_tokens"]) for r in out if r["doc_id"] == 1)
    assert first == [(0, 10), (1, 10), (2, 5)]
    load = Counter()
    for r in out:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 10 and sum(load.values()) == 49 and set(load) == set(range(len(load)))
    assert pack(spark, []) == []
    assert [r["container"] for r in pack(spark, [(1, 0, "", "")])] == [0]


def test_a_frequent_length_is_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    out = pack(spark, [(i, 4, "", "") for i in range(300)])
    load = Counter(r["container"] for r in out)
    assert len(out) == 300 and max(load.values()) == 2 and len(load) == 150


@pytest.mark.parametrize("seed", range(4))
def test_patterns_lose_nothing_to_best_fit_alone(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.4 + 0.2 * seed, 0.8, 20_000).astype(int) + 1, 1, 2048)
    base = Counter(lengths.tolist())
    table, total = packing.plan(base)
    monkeypatch.setattr(packing, "FITTED", 0.0)
    alone = packing.plan(base)[1]
    assert total <= alone * 1.0005 and total * 2048 >= lengths.sum()


@pytest.mark.parametrize("seed", range(4))
def test_patterns_place_most_pieces(seed):
    """Of texts mostly shorter than a third of a container too, and not only of copies of a container's length."""
    rng = np.random.default_rng(seed)
    base = Counter(np.clip(rng.lognormal(5.4 + 0.2 * seed, 0.8, 20_000).astype(int) + 1, 1, 2047).tolist())
    for times in (1, 1000):
        placed = []
        packing.plan({k: v * times for k, v in base.items()}, tally=placed.append)
        assert placed[0] > 0.6 * times * base.total()


@pytest.mark.parametrize("seed", range(4))
def test_no_container_more_than_best_fit_alone(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    base = Counter(np.clip(rng.lognormal(5.4 + 0.2 * seed, 0.8, 20_000).astype(int) + 1, 1, 2048).tolist())
    total = check(base, 2048)[1]
    monkeypatch.setattr(packing, "FITTED", 0.0)
    assert total <= packing.plan(base)[1] + 1
