import random
import re
from collections import Counter

from gleanery.llm import corpus, termfreq


def brute(texts):
    occurrences, records = Counter(), Counter()
    for t in texts:
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")]
        occurrences.update(w)
        records.update(set(w))
    return {t: (n, records[t]) for t, n in occurrences.items()}


def counted(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, term string")
    return {r["term"]: (r["occurrences"], r["records"]) for r in termfreq.term_counts(df.repartition(3)).collect()}


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "The", "aaa", "aab", "aabc", f"t{rnd.randrange(400)}", "é", "K", "x-y"]) for _ in range(rnd.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "!!", "the " * 5000]
    assert counted(spark, texts) == brute(texts)
    monkeypatch.setattr(termfreq, "HELD", 50)  # tries are sent off many times
    monkeypatch.setattr(termfreq, "ROUTES", 4)
    assert counted(spark, texts) == brute(texts)
    # Containers that are finer than the routes in one task and coarser in another.
    monkeypatch.setattr(termfreq, "ROUTES", 10**9)
    texts += [f"abcdefgh{i} abcdefgh{i % 7} abcdefghi" for i in range(200)]
    assert counted(spark, texts) == brute(texts)
    assert counted(spark, []) == {} and counted(spark, [None, ""]) == {}


def test_trie_bursts():
    trie = termfreq.BurstTrie(burst=4)
    words = [f"ab{i}" for i in range(50)] + ["a", "", "ab", "b"]
    for w in words * 2:
        trie.add(w, 2, 1)
    held = {p + rest: tuple(n[:2]) for p, c in trie.containers() for rest, n in c.items()}
    assert held == {w: (4, 2) for w in words} and trie.size == len(words)
    assert max(len(p) for p, _ in trie.containers()) > 1


def test_grafted_tries_are_the_trie_of_all():
    rnd = random.Random(5)
    texts = [[rnd.choice("aab") + str(rnd.randrange(300)) for _ in range(40)] + ["a", "ab"] for _ in range(30)]
    whole, parts = termfreq.BurstTrie(burst=8), [termfreq.BurstTrie(burst=b) for b in (4, 8, 64)]
    for k, t in enumerate(texts):
        whole.count(t, k)
        parts[k % 3].count(t, k)
    merged = termfreq.BurstTrie(burst=8)
    for part in parts:
        for prefix, held in part.containers():
            merged.graft(prefix, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()])
    flat = lambda trie: {p + r: tuple(n[:2]) for p, c in trie.containers() for r, n in c.items()}
    assert flat(merged) == flat(whole) == brute([" ".join(t) for t in texts]) and merged.size == whole.size
    assert max(len(p) for p, _ in merged.containers()) > 1


def test_marks(spark):
    rows = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 11), ("d", 9, 10)], "term string, occurrences int, records int")
    marks = lambda n: {r["term"]: r["mark"] for r in termfreq.marked(rows, n).collect()}
    assert marks(100) == {"a": "rare", "b": None, "c": "common", "d": None}
    assert marks(5)["a"] == "rare"  # both


def test_passages(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("", "y", 1), (None, "z", 1), ("b", None, 1), ("c", None, 1), ("c", "w", 1)]
    out = corpus.passages(spark.createDataFrame(rows, "id string, text string, n int")).collect()
    assert sorted((r["id"], r["text"]) for r in out if r["text"]) == [("a", "x"), ("c", "w")] and len(out) == 3
