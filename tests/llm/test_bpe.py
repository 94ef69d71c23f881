import random

import pytest
from tokenizers import Tokenizer

from gleanery.llm import bpe

PUBLIC = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(PUBLIC)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return bpe.BytePairEncoder()


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a", " a", "a ", "a  b", "\n a", "a \n b", "<|endoftext|>", "it's we'll", "漢字かな交じり文", "é  x",
     "\x1c \x1c", "a  b", "1234 5678", "!!!???", "x" * 5000, "ab" * 3000, "é" * 999, "​ ​"],
)
def test_equals_the_public_tokenizer(own, public, text):
    assert own.encode(text) == public(text)


def test_random_texts(own, public):
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice("ab  \n\t\x1c\x85 é漢'st'll12<|>!?​　") for _ in range(rnd.randrange(30)))
        assert own.encode(text) == public(text), repr(text)


def test_merge_is_the_definition(own):
    def plain(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            ranked = [(own.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks]
            if not ranked:
                return tuple(own.ranks[p] for p in parts)
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(2)
    for _ in range(500):
        raw = bytes(rnd.choice(b"thequickbrownaeio") for _ in range(rnd.randrange(1, 60)))
        assert own.merge(raw) == plain(raw)


def test_table_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 10)
    e = bpe.BytePairEncoder()
    text = " ".join(f"word{i}" for i in range(100)) + " " + "y" * 200
    assert e.encode(text) == own.encode(text)
    assert len(e._by_piece) <= 10 and len(e._by_word) <= 10


def test_rows(spark, own):
    rows = [(1, "a b", "z"), (2, None, "z"), (3, "", "z"), (None, "a b", "z"), (1, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = [(r["doc_id"], r["ids"]) for r in bpe.encode(docs).collect()]
    ab = own.encode("a b")
    assert sorted(out, key=repr) == sorted([(1, ab), (2, []), (3, []), (None, ab), (1, ab)], key=repr)
    assert bpe.encode(docs.limit(0)).collect() == []
    counts = {r[0]: r[1] for r in bpe.count_tokens(docs.where("doc_id > 1")).collect()}
    assert counts == {2: 0, 3: 0}
