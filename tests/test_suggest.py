import pytest

from gleanery.operators import suggest


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("science", 50), ("scientist", 30), ("scientific", 90), ("scope", 10), ("search", 100)], "term string, weight bigint")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("science", 90), ("scientist", 30), ("machine", 100), ("learning", 80), ("the", 1000)], "term string, weight bigint")


@pytest.mark.parametrize(
    "prefix,k,want",
    [("sci", 8, ["scientific", "science", "scientist"]), ("sci", 2, ["scientific", "science"]), ("scope", 8, ["scope"]), ("zzz", 8, []), ("sci", 0, [])],
)
def test_complete(vocab, prefix, k, want):
    assert [r["term"] for r in suggest.complete(vocab, prefix, k).collect()] == want


def test_empty_prefix_and_batches(spark, vocab):
    assert [r["term"] for r in suggest.complete(vocab, "").collect()][0] == "search"
    asked = spark.createDataFrame([("sci",), ("",), ("zz",), (None,), ("sci",)], "prefix string")
    got = {}
    for r in sorted(suggest.complete_all(vocab, asked).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["prefix"], []).append(r["term"])
    assert got["sci"] == ["scientific", "science", "scientist"] and len(got[""]) == 5 and "zz" not in got


def test_weights_add_up(spark, vocab):
    more = spark.createDataFrame([("scope", 200), ("", 5), ("none", 0)], "term string, weight bigint")
    got = {r["term"]: r["weight"] for r in suggest.add_terms(vocab, more).collect()}
    assert got["scope"] == 210 and len(got) == 5


@pytest.mark.parametrize("a,b,d", [("", "", 0), ("abc", "abc", 0), ("abc", "ab", 1), ("ab", "abc", 1), ("abc", "abd", 1), ("teh", "the", 1), ("kitten", "sitting", 3), ("ca", "abc", 3)])
def test_distance(a, b, d):
    assert suggest.osa(a, b) == suggest.osa(b, a) == d


def test_correct(spark, words):
    asked = spark.createDataFrame([("machine",), ("machkne",), ("machne",), ("teh",), ("zzzzzz",), ("",), (None,)], "word string")
    got = {r["word"]: (r["term"], r["distance"]) for r in suggest.correct_all(words, asked, 1).collect()}
    assert got == {"machine": ("machine", 0), "machkne": ("machine", 1), "machne": ("machine", 1), "teh": ("the", 1)}


def test_bytes_not_signs(spark):
    vocab = spark.createDataFrame([("cafe", 1)], "term string, weight bigint")
    asked = spark.createDataFrame([("café",)], "word string")
    assert suggest.correct_all(vocab, asked).first()["distance"] == 2


def test_ties_prefer_weight_then_term(spark):
    vocab = spark.createDataFrame([("bat", 1), ("cat", 5), ("hat", 5)], "term string, weight bigint")
    got = suggest.correct_all(vocab, spark.createDataFrame([("aat",)], "word string")).orderBy("rank").collect()
    assert [r["term"] for r in got] == ["cat", "hat", "bat"]


def test_queries(spark, words):
    rows = [("a", "Machkne Learning teh"), ("b", "The MACHINE"), ("c", None), ("d", ""), ("a", "Machkne Learning teh")]
    got = {r["qid"]: r["corrected"] for r in suggest.correct_queries(words, spark.createDataFrame(rows, "qid string, query string")).collect()}
    assert got == {"a": "machine Learning the", "b": None, "c": None, "d": None}


def test_accuracy_and_messages(spark, words):
    pairs = spark.createDataFrame([("teh", "the"), ("zzzzzz", "the")], "typo string, expected string")
    assert tuple(suggest.accuracy(words, pairs).first()) == (2, 1, 50.0)
    with pytest.raises(ValueError):
        suggest.accuracy(words, pairs.limit(0))
    assert suggest.message("x", []).endswith("no suggestion") and "spelled correctly" in suggest.message("x", [("x", 0)])
    assert "others: b" in suggest.message("x", [("a", 1), ("b", 2)])
    known = {"the"}.__contains__
    assert [suggest.intent(x, known) for x in ("sci*", "?teh", "the", "teh")] == [("complete", "sci"), ("correct", "teh"), ("complete", "the"), ("correct", "teh")]


def test_many_distances_at_once():
    import random

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(9)))
    pairs = [(word(), word()) for _ in range(600)] + [("", ""), ("", "abc"), ("abcdefghij" * 5, "abcdefghji" * 5)]
    assert suggest.osa_all(*map(list, zip(*pairs))).tolist() == [suggest.osa(a, b) for a, b in pairs]
    assert len(suggest.osa_all([], [])) == 0
