import math
import random
import re
from collections import Counter

import pytest

from gleanery.llm import distinctive


def brute(rows, n_records, n, by):
    tf = {i: Counter(x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")) for i, t in rows}
    df = Counter(w for c in tf.values() for w in c)
    col = Counter()
    for c in tf.values():
        col.update(c)
    total = sum(col.values())
    out = set()
    for i, c in tf.items():
        r = sum(c.values())

        def residual(w):
            e = r * col[w] / total
            m = (1 - r / total) * (1 - col[w] / total)
            return round((c[w] - e) / math.sqrt(e * m), 9) if m > 0 else 0.0

        score = {"tfidf": lambda w: c[w] * math.log(1 + (n_records - df[w] + 0.5) / (df[w] + 0.5)), "residual": residual}[by]
        out |= {(i, w) for w in sorted(c, key=lambda w: (-score(w), w))[:n]}
    return out


@pytest.mark.parametrize("by", ["tfidf", "residual"])
@pytest.mark.parametrize("fits", [True, False])
def test_equals_brute_force(spark, monkeypatch, by, fits):
    monkeypatch.setattr(distinctive, "fits_broadcast", lambda *a: fits)
    rnd = random.Random(4)
    rows = [(f"r{k}", "the " + " ".join(rnd.choice("aabbcdefghij") + str(rnd.randrange(3)) for _ in range(rnd.randrange(20)))) for k in range(150)]
    rows += [("n", None), ("e", ""), ("s", "?!"), ("one", "solo"), ("long", "word " * 20_000)]
    df = spark.createDataFrame(rows, "id string, text string")
    out = distinctive.distinctiveness(df, len(rows), by=by)
    assert {(r["id"], r["term"]) for r in out.collect()} == brute(rows, len(rows), 3, by)
    assert out.columns == ["id", "term", "tf", "df", "tfidf", "residual", "rank"]


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert distinctive.distinctiveness(df, 0).collect() == []
