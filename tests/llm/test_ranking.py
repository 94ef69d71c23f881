from gleanery.llm import ranking

COLUMNS = ["a", "b", "c"]
SCHEMA = "g string, i string, a double, b double, c double, rank int, closeness string"


def order(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    out = ranking.ideal_point(df, "g", "i", COLUMNS, **kw).collect()
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r["g"], []).append(r["i"])
    return found


def test_no_score_rules_by_its_range(spark):
    # Only c, on a tiny scale, agrees with b; a has one huge value.
    rows = [("g", f"d{i}", 1000.0 - i, 0.5 + i * 0.01, i * 1e-6) for i in range(20)] + [("g", "wild", 1e9, 0.4, -1e-6)]
    assert order(spark, rows)["g"][0] == "d19"
    assert order(spark, rows)["g"].index("wild") > 5


def test_missing_stands_below_every_present_one(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("g", "x", 5.0, 5.0, None), ("g", "y", None, 5.0, None), ("g", "z", nan, 5.0, None), ("g", "w", inf, 6.0, None), ("g", "v", 5.0, 5.0, None)]
    found = order(spark, rows)["g"]
    assert found.index("v") < found.index("x") < found.index("y") < found.index("z")


def test_edges(spark):
    rows = [(None, "b", 1.0, None, None), (None, "a", 1.0, None, None), ("h", "only", None, None, None), ("g", None, 1.0, 1.0, 1.0), ("k", "t", 1.0, 1.0, 1.0), ("k", "t", 1.0, 1.0, 1.0)]
    assert order(spark, rows) == {None: ["a", "b"], "h": ["only"], "k": ["t"]}
    assert order(spark, []) == {}


def test_leaders(spark):
    rows = [("g", f"d{i}", float(i), float(i), float(i), 0, "") for i in range(9)]
    out = ranking.leaders(spark.createDataFrame(rows, SCHEMA), "g", "i", COLUMNS, n=2).collect()
    assert [(r["i"], r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [("d8", 1), ("d7", 2)]
