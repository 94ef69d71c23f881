import random

import duckdb
import pytest

from gleanery.llm import spam

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def ordinary(spark):
    from gleanery.runtime import ship

    ship(spark)
    return spam.fit(spark.read.parquet(f"{D}/documents.parquet"))


@pytest.fixture(scope="module")
def judged():
    return duckdb.sql(
        f"""SELECT text, min(label) FROM read_parquet('{D}/documents.parquet') d JOIN read_parquet('{D}/page_labels.parquet') l USING (doc_id)
            WHERE label IS NOT NULL GROUP BY doc_id, text HAVING count(DISTINCT label) = 1"""
    ).fetchall()


PROSE = "The team at the harbour measured the pressure of the water and found that it was lower than in the year before. "


@pytest.mark.parametrize(
    "text",
    [
        "cheap tutor | best tutor | tutor near me | tutor reviews | cheap tutor online | " * 4,
        "Poker free sofa buy offer wholesale free wholesale poker! Poker sleeve free buy offer free sofa. " * 5,
        "#cheapmattress #bestkettle #dealsbackpack #buysofa #freeposter #saletent " * 4,
        "http://a.example/x\nhttp://b.example/y\nhttp://c.example/kettle\nhttp://d.example/sofa\n" * 4,
        "Home > Archive > Kidney prev :: Muscle / Plasma (87) :: Trial > Gallery > Sleep next :: " * 4,
        " ".join(" ".join(w) for w in ["cheap", "tent", "buy", "deals", "sofa"] * 12),
        "­".join("best price order now cheap sofa deals online store ") * 6,
        "最安値 割引 ランキング grill, 通販 printer, ランキング 割引 grill, 送料無料 grill, " * 6,
    ],
)
def test_spam(text, ordinary):
    assert spam.spam_share(text, ordinary) > 0.5
    assert spam.spam_share(PROSE * 20 + text[:300], ordinary) <= spam.SHARE


@pytest.mark.parametrize(
    "text",
    [
        PROSE * 30,  # a refrain
        "58037 22.421 miss\n20049 30.079 ok\n" * 40,
        "0 0 0 0 " * 100,
        "=" * 900,
        "~*" * 400,
        "B22oxF+r7PRlTpCygK2nMvXaBytR5RNVBJ" * 40,
        "engine_k = 0.9\nlipid_limit = 60\ncell_depth = true\n" * 20,
        "新しい索引を作り、研究者たちは確認した。値は低かった。" * 20,
        "Образцы был слишком коротким. Новый указатель хранит слова и частоты. " * 20,
        "",
        "   ",
        "untitled",
        None,
    ],
)
def test_no_spam(text, ordinary):
    assert spam.spam_share(text, ordinary) <= spam.SHARE


def test_rows(spark, ordinary):
    bad = "cheap tutor | best tutor | tutor near me | tutor reviews | " * 9
    rows = [(1, bad, "x"), (1, bad, "x"), (2, PROSE, "x"), (3, None, "x"), (4, "", "x"), (None, bad, "x"), (5, PROSE * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share string")
    assert sorted((r["doc_id"] for r in spam.spam_pages(df, ordinary=ordinary).collect()), key=str) == [1, 1, None]
    assert spam.spam_pages(df.limit(0)).collect() == [] and spam.spam_pages(df).columns == ["doc_id", "share"]


def found(judged, ordinary):
    return [(spam.spam_share(t, ordinary) > spam.SHARE, label == "spam") for t, label in judged]


def test_agrees_with_the_judgements(judged, ordinary):
    rows = found(judged, ordinary)
    assert sum(a == b for a, b in rows) >= 0.93 * len(rows)  # some judgements are wrong


@pytest.mark.parametrize("size,least,most", [(10**6, 0, 0), (0, 3, 99)])
def test_nothing_is_decided_without_compression(judged, ordinary, monkeypatch, size, least, most):
    """With every block at one size nothing is found, or several times as much as there is."""
    monkeypatch.setattr(spam, "compressed", lambda text: size)
    rows = found(judged, ordinary)
    assert least <= sum(a for a, _ in rows) / sum(b for _, b in rows) <= most


@pytest.mark.parametrize(
    "text",
    [
        "便宜手机，手机价格，手机优惠，购买手机，" * 30,
        "дешёвые билеты купить билеты билеты онлайн скидки билеты " * 20,
        "φθηνά εισιτήρια αγορά εισιτήρια προσφορές εισιτήρια " * 20,
        "रेल टिकट खरीदें टिकट ऑफर सस्ते टिकट " * 25,
        "رخيص تذاكر شراء تذاكر عروض تذاكر " * 25,
        "싼 항공권 항공권 예약 항공권 할인 " * 30,
        "cheap flights to the city of rome " * 40,
    ],
)
def test_repetition_in_any_script(text, ordinary):
    assert spam.spam_share(text, ordinary) > 0.5
    assert spam.spam_share("रेशा होता है। बदल जाता है। सूची में शब्द हैं। " * 20, ordinary) <= spam.SHARE


def test_all_pages_are_fitted(spark):
    """Words in exactly half of 12,000 pages are common, those in one page fewer aren't; the median is that of all blocks."""
    n, half = 12_000, [f"half{chr(97 + k)}" for k in range(20)]
    rows = []
    for i in range(n):
        have = [w for k, w in enumerate(half) if (i + 97 * k) % n < n // 2 - k % 2]
        tail = " ".join(f"{'xyz'[(i * (k + 3)) % 3]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for k in range(i % 40))
        rows.append((i, " ".join([*have, "always", tail]), "en"))
    found = spam.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert found.common == {"always", *half[::2]}
    first = spam.Ordinary(found.common)
    sizes = []
    for _, t, _ in rows:
        for at, size in spam.blocks(spam.words(t)):
            text = " ".join(at)
            if size >= spam.BLOCK // 2 and not spam.wordless(at, text):
                sizes.append(max(0, spam.compressed(first.structure(at)) - spam.BASE) / len(text))
    assert found.size == {"LATIN": sorted(sizes)[(len(sizes) - 1) // 2]}


def test_blocks_measured_first_are_judged_as_one_by_one(spark, judged):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(judged)], "doc_id bigint, text string")
    ordinary = spam.fit(df, lang_col=None)
    want = {i: spam.spam_share(t, ordinary) for i, (t, _) in enumerate(judged)}
    for given in (None, ordinary):
        got = {r["doc_id"]: r["share"] for r in spam.spam_pages(df, ordinary=given).collect()}
        assert got == {i: x for i, x in want.items() if x > spam.SHARE} and len(got) > 50


class Counted:
    """A pattern that counts its uses."""

    def __init__(self, pattern):
        self.pattern, self.uses = pattern, 0

    def __getattr__(self, name):
        self.uses += 1
        return getattr(self.pattern, name)


def test_words_are_looked_at_once(monkeypatch):
    """The work by patterns goes with the different words of a text, not with its blocks."""
    common, uses = frozenset(["the", "at", "of", "and", "that", "it", "was", "in"]), []
    monkeypatch.setattr(spam, "_UNIT", Counted(spam._UNIT))
    for n in (10, 1000):
        before = spam._UNIT.uses
        assert spam.spam_share(PROSE * n, spam.Ordinary(common)) == 0
        uses.append(spam._UNIT.uses - before)
    assert uses[0] == uses[1] > 0


def test_looks_of_words_give_those_of_blocks():
    """Doubt and wordlessness of blocks, from the looks of their words, are those of the whole text by patterns."""
    common, seen = frozenset(["the", "of", "w", "2nd", "дом", "検"]), set()
    ordinary, rng = spam.Ordinary(common), random.Random(7)
    pieces = ["the", "of", "w", "cheap", "2nd", "дом", "検索", "ไทย", "是。", "！", "है।", "1.2", "²", "١٢", "http://a.b/x.", "\x0212", "\x02ab", "_a"]
    pieces += [".", "..", "?!", "…", "؟", "=", "#tag", "<b", ").", '."', "-", "x" * 45, "日" * 40, "é", "̈"]
    for _ in range(1500):
        pool = rng.sample(pieces, rng.randint(2, 9))
        at = spam.words(" ".join("".join(rng.choices(pool, k=rng.choice((1, 1, 2, 3)))) for _ in range(rng.randint(12, 60))))
        text, structure = " ".join(at), ordinary.structure(at)
        letters, digits = "".join(spam._WORD.findall(text)), sum(any(map(str.isdigit, w)) for w in at)
        none = text.count("=") >= 0.2 * len(at) or len(letters) < 0.45 * len(text) or len(set(letters)) < 5 or digits / len(at) >= 0.35
        none = none or sum(len(w) for w in at if len(w) > 40 and w.isascii()) / len(text) > 0.4
        none = none and len(spam._LINK.findall(text)) < 0.2 * len(at)
        assert spam.wordless(at, text) == none
        n = start = 0
        for m in spam._END.finditer(structure):
            n += sum(u != "w" for u in spam._UNIT.findall(structure, start, m.start() + 1)) >= 2
            start = m.end()
        single = len(spam._SINGLE.findall(text))
        size = max(1, len(spam._UNIT.findall(text)) - single + single / 3)
        want = None if none or len(text) < spam.BLOCK // 4 else (spam.compressed(structure), len(text), (n < spam.FEW * size) + (n < spam.HARDLY * size))
        got = spam.measure(at, ordinary)
        assert (got and got[1:]) == want
        seen.add(want and want[2])
    assert seen == {None, 0, 1, 2}


@pytest.mark.parametrize("word", ["7" * 500_000, "7" * 500_000 + "a", "_7" * 250_000, "a." * 250_000])
def test_time_of_overlong_words(word, ordinary):
    """A word of half a million signs takes no square of its length, in the fit or after it."""
    assert len(spam.Units()[word]) == word.count("a")
    assert spam.spam_share(word, ordinary) == spam.spam_share(f"{word} {word}", ordinary) == 0
