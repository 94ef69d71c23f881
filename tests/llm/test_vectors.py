import duckdb
import numpy as np

from gleanery.llm import vectors

PATH = "/root/testdata/sf0.01/doc_vectors.parquet"


def brute(rows, k=5, least=0.85, dim=64):
    good = {}
    for i, e in rows:
        if i and e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e) and any(e):
            good[i] = max(good.get(i, e), e)
    ids = sorted(good)
    if not ids:
        return {}
    x = np.array([good[i] for i in ids], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for a, i in enumerate(ids):
        s = np.round(x @ x[a], 6)
        s[a] = -9
        out[i] = [(ids[b], s[b]) for b in np.lexsort((np.arange(len(ids)), -s)) if s[b] >= least][:k]
    return out


def found(df, **kw):
    out = {}
    for r in sorted(vectors.most_similar(df, **kw).collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["neighbour"], r["similarity"]))
    return out


def test_recall_on_the_table(spark):
    want = brute(duckdb.sql(f"SELECT id, embedding FROM read_parquet('{PATH}')").fetchall())
    got = found(spark.read.parquet(PATH), cell=64, probes=4)
    pairs = lambda x: {(i, n) for i, l in x.items() for n, _ in l}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(pairs(want))


def test_exact_where_all_cells_are_visited(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    v = (centers[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.3).astype(np.float32).tolist()
    rows = [(f"v{i:03}", e) for i, e in enumerate(v)]
    rows += [(f"w{i}", v[0]) for i in range(9)] + [(f"v{i:03}", v[i]) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    rows += [("n", None), ("z", [0.0] * 8), ("s", [1.0] * 7), ("x", [nan] * 8), ("y", [inf] + [0.0] * 7), ("u", [None] + [1.0] * 7), ("", v[1]), (None, v[1]), ("big", [1e30 * x for x in v[5]])]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "id string, embedding array<float>, v string, cell int")
    want = {i: l for i, l in brute(rows, dim=8).items() if l}
    same = lambda a, b: {i: [n for n, _ in l] for i, l in a.items()} == {i: [n for n, _ in l] for i, l in b.items()}
    monkeypatch.setattr(vectors, "PARTS", 4)
    assert same(found(df, dim=8, cell=64, probes=99), want)
    monkeypatch.setattr(vectors, "MEMBERS", 16)
    monkeypatch.setattr(vectors, "QUERIES", 32)
    assert same(found(df, dim=8, cell=64, probes=99), want)


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "id string, embedding array<float>")
    assert vectors.most_similar(df).collect() == []
    assert vectors.most_similar(df.limit(0)).columns == ["id", "neighbour", "similarity", "rank"]
