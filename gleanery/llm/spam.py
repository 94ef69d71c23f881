"""Pages of repeated keywords, link entries or product tags instead of sentences, by block-wise compression.

A text is cut into blocks of about BLOCK signs. Sentences differ in structure from word to word: common words, rare
words and marks follow each other in ever new ways. Lists of keywords, links, menu entries and tags don't. So what is
compressed of a block is its structure, in which every word that isn't common in its language is one sign, links too,
and numbers another. The size per sign is held against what ordinary blocks of that script need, both of which are
fitted on all pages of the collection: the words that at least half of a language's pages have, and the median size per
sign of each script. A block far below is extremely redundant, and is spam if, besides, it ends hardly any
sentence: a sentence is what a full stop closes and holds common words. Blocks of numbers, encoded data or filler signs
hold no words and never count. A text is a case if such blocks hold over SHARE of it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import materialise

#: Signs of a block.
BLOCK = 160

#: Pages a language must have (of few pages, two and a fiftieth); share of these that a common word is found in; blocks
#: that a script's median needs.
PAGES, COMMON, BLOCKS = 10, 0.5, 50

#: Words counted in a task beyond which their counts are sent on, with the batch.
AT_ONCE = 500_000

#: Bytes that any block takes, and the size per sign of ordinary ones where a script has too few.
BASE, USUAL = 6, 0.4

#: Parts of the ordinary size: below the first a block is redundant beyond doubt, below the second suspect.
EXTREME, SUSPECT = 0.4, 0.65

#: Sentences a word below which redundant blocks, and suspect ones, are confirmed.
FEW, HARDLY = 0.06, 0.02

#: Part of the text that spam blocks must hold. Blocks on the edges of a list hold sentences too and don't count, so it
#: is under a half.
SHARE = 0.2

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPELT_OUT = re.compile(r"\b[^\W\d_]([ .\-_*])(?:[^\W\d_]\1)+[^\W\d_](?!\w)")
_MAY_BE_SPELT_OUT = re.compile(r"([ .\-_*])[^\W\d_]\1[^\W\d_](?!\w)")
_SPELT = "\x02"
_LINK = re.compile(r"https?:|www\.|href|\]\(|(?<!\w)#\w|[^\W\d]:\w|<\w|\w\.\w[\w.-]*/")
_ADDRESS = re.compile(rf"(?:https?:|www\.)\S+|{_SPELT}[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = "฀-໿⺀-⿟々-〇ぁ-ゖァ-ヺー㐀-䶿一-鿿"
# Looked for where a run of signs starts only: from each digit of a long number on it would take the square of its length.
_UNIT = re.compile(rf"[{_UNSPACED}]|(?<![^\W_{_UNSPACED}])[^\W_{_UNSPACED}]*[^\W\d_{_UNSPACED}][^\W_{_UNSPACED}]*")
_NUMBER = re.compile(r"\d+")
_END = re.compile(r"\w[.!?؟…]+(?=\s|$)|[।。！？]")
_SINGLE = re.compile(f"[{_UNSPACED}]")


@lru_cache(maxsize=100_000)
def script(sign: str) -> str:
    """Name of a letter's script, the ideographs and syllables of one page being one."""
    name = unicodedata.name(sign, "OTHER").split()[0].split("-")[0]
    return "CJK" if name in {"HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA"} else name


class Units(dict):
    """The units of the words seen so far."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        found = (word,) if word.isascii() and word.isalpha() else tuple(_UNIT.findall(word))
        if len(word) <= 64:
            self[word] = found
        return found


class Ordinary(dict):
    """What ordinary pages are like: common units, and each script's size per sign; and the looks of words seen so far.

    The looks are the structure; a c for each common unit (two at most between stops) and a full stop for each stop; the
    units, and those of one sign in scripts without spaces; the letters, whether five of them differ, 1 for a word with a
    digit, and the signs of a long word in ASCII. None of them depends on the words around.
    """

    def __init__(self, common: frozenset = frozenset(), size: dict | None = None):
        self.common, self.size = common, size or {}
        self.known = frozenset(script(u[0]) for u in common)

    def __missing__(self, word: str) -> tuple[str, str, int, int, int, bool, int, int]:
        if len(self) > 500_000:
            self.clear()
        plain = word.isascii()
        long = len(word) if plain and len(word) > 40 else 0
        if plain and word.isalpha():  # a unit as it is
            structure = word if word in self.common or "LATIN" not in self.known else "w"
            found = structure, "" if structure == "w" else "c", 1, 0, len(word), len(set(word)) >= 5, 0, long
        else:
            units, digit = _UNIT.findall(word), any(map(str.isdigit, word))
            structure = _ADDRESS.sub("w", word) if _SPELT in word or "http" in word or "www." in word else word
            structure = _UNIT.sub(self._sign, structure)
            if digit:
                structure = _NUMBER.sub("0", structure)
            letters = "".join(units if plain and not digit else _WORD.findall(word))
            single = 0 if plain else len(_SINGLE.findall(word))
            found = structure, stops(structure), len(units), single, len(letters), len(set(letters)) >= 5, int(digit), long
        if len(word) <= 64:
            self[word] = found
        return found

    def _sign(self, m: re.Match) -> str:
        """A common unit, and one in a script without common units, as it is; any other as one sign."""
        unit = m.group(0)
        return unit if unit in self.common or script(unit[0]) not in self.known else "w"

    def structure(self, at: list[str]) -> str:
        return " ".join([self[w][0] for w in at])


def stops(structure: str) -> str:
    """The common units of a word's structure, two at most between stops, and its full stops."""
    found, start = "", 0
    if structure[-1] in ".!?" or not structure.isascii():
        for m in _END.finditer(structure):
            found += _commons(structure, start, m.start() + 1) + "."
            start = m.end()
    return found + _commons(structure, start, len(structure))


def _commons(structure: str, start: int, stop: int) -> str:
    units = _UNIT.findall(structure, start, stop)
    return "c" * min(2, len(units) - units.count("w"))


def _joined(m: re.Match) -> str:
    """Letters spelt out, put together and marked; where no word ends show, in pieces of a word's length."""
    w = m.group(0).replace(m.group(1), "")
    return _SPELT + w if len(w) <= 20 else " ".join(_SPELT + w[i : i + 8] for i in range(0, len(w), 8))


def compressed(text: str) -> int:
    """Bytes of a text in raw deflate."""
    return len(zlib.compress(text.encode("utf-8", "replace"), 6, -15))


def words(text: str) -> list[str]:
    """The words of a text in lower case, invisible signs dropped and spelt-out words joined.

    Sentences without spaces are cut into pieces of 32 signs.
    """
    plain = text.isascii()
    low = text.lower() if plain else _INVISIBLE.sub("", text).lower()
    found = (_SPELT_OUT.sub(_joined, low) if _MAY_BE_SPELT_OUT.search(low) else low).split()
    if plain:
        return found
    return [p for w in found for p in ([w] if len(w) <= 32 or w.isascii() else [w[i : i + 32] for i in range(0, len(w), 32)])]


def blocks(found: list[str], block: int = BLOCK) -> Iterator[tuple[list[str], int]]:
    """(words, signs) of the blocks of a text, all about equally long."""
    ends = list(accumulate(map(add, map(len, found), repeat(1))))
    total = ends[-1] if ends else 0
    n = max(1, round(total / block))
    start = done = 0
    while start < len(found):
        stop = bisect_left(ends, -(-total * (done * n // total + 1) // n), start) + 1
        yield found[start:stop], ends[stop - 1] - done
        start, done = stop, ends[stop - 1]


def wordless(at: list[str], text: str, looks: list | None = None) -> bool:
    """Whether a block is of numbers, settings, encoded data or filler signs; links and tags are words.

    ``looks`` are the last four of its words' looks, if they are known.
    """
    n = len(at)
    letters, varied, digit, long = looks or list(zip(*map(Ordinary().__missing__, at)))[4:]
    none = text.count("=") >= 0.2 * n or sum(letters) < 0.45 * len(text) or sum(digit) / n >= 0.35 or sum(long) / len(text) > 0.4
    none = none or (True not in varied and len(set("".join(_WORD.findall(text)))) < 5)
    return none and len(_LINK.findall(text)) < 0.2 * n


def main_script(text: str) -> str:
    """The script of most letters among every eighth sign of a text."""
    if text.isascii():
        return "LATIN"
    letters = [script(c) for c in text[::8] if c.isalpha()]
    return max(set(letters), key=letters.count) if letters else ""


def measure(at: list[str], ordinary: Ordinary) -> tuple[str, int, int, int] | None:
    """(script, bytes of the compressed structure, signs, doubt) of a block; none for one that is wordless or too short.

    The doubt is 0 if the block ends sentences, 1 if it ends few, 2 if hardly any. A sentence is a full stop behind at
    least two common units since the one before; three signs of scripts without spaces are one word.
    """
    text = " ".join(at)
    if len(text) < BLOCK // 4:
        return None
    structure, ends, units, single, *looks = zip(*map(ordinary.__getitem__, at))
    if wordless(at, text, looks):
        return None
    if n := "".join(ends).count("cc."):
        alone = sum(single)
        size = max(1, sum(units) - alone + alone / 3)
        doubt = int(n < FEW * size) + int(n < HARDLY * size)
    else:
        doubt = 2
    return main_script(text), compressed(" ".join(structure)), len(text), doubt


def confirmed(part, doubt):
    """Whether blocks whose size is this part of the ordinary one are spam; numbers or arrays."""
    return (doubt > 0) & (part < EXTREME) | (doubt > 1) & (part < SUSPECT)


def is_spam(at: list[str], ordinary: Ordinary) -> bool:
    """Whether a block of words is redundant in structure and hardly holds a sentence."""
    found = measure(at, ordinary)
    if found is None:
        return False
    name, size, signs, doubt = found
    return confirmed(max(0, size - BASE) / (ordinary.size.get(name, USUAL) * signs), doubt)


def spam_share(text: str | None, ordinary: Ordinary, block: int = BLOCK) -> float:
    """Part of the visible signs of a text that lies in spam blocks; 0 for a text without words."""
    total = spam = 0
    for at, size in blocks(words(text), block) if text else ():
        total += size
        spam += size if is_spam(at, ordinary) else 0
    return spam / max(1, total)


def _texts(documents: DataFrame, text_col: str, *others: Column) -> DataFrame:
    """The columns asked for and the text, of rows whose text is neither null nor empty."""
    return documents.select(*others, F.col(f"`{text_col}`").alias("__text")).where("__text is not null and __text <> ''")


def common_units(documents: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> frozenset:
    """Units that at least half of the pages of a language have, counted over all pages.

    Pages are taken by the first two letters of their language label, right or wrong: a word counts as common that half
    of the pages of any label with enough pages have. Pages without a label are a group of their own.
    """
    label = F.lower(F.substring(F.trim(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).cast("string")), 1, 2)) if lang_col else F.lit("")
    rows = _texts(documents, text_col, label.alias("g"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Units(), defaultdict(Counter)
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[g].update({""}.union(*map(known.__getitem__, set(words(t)))))
            if sum(map(len, counts.values())) > AT_ONCE:
                yield from sent(counts)
        yield from sent(counts)

    def sent(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for g, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["g", "u", "n"])
        counts.clear()

    seen = rows.mapInArrow(units, "g string, u string, n bigint").groupBy("g", "u").agg(F.sum("n").alias("n"))
    seen = materialise(seen, "units")
    pages = seen.where("u = ''").select("g", F.col("n").alias("pages"))
    least = min(PAGES, max(2, (pages.agg(F.sum("pages")).first()[0] or 0) // 50))
    pages = F.broadcast(pages.where(F.col("pages") >= least))  # a row for each label, of two signs
    often = seen.where("u <> ''").join(pages, "g").where(F.col("n") >= COMMON * F.col("pages"))
    return frozenset(r["u"] for r in often.select("u").distinct().collect())  # a few hundred words a language


def _measured(rows: DataFrame, common: frozenset) -> DataFrame:
    """The rows of (__id, __text) as (__id, total, script, size, signs, doubt): signs of a text, and its measured blocks."""
    held = rows.sparkSession.sparkContext.broadcast(common)
    names = ["__id", "total", "script", "size", "signs", "doubt"]
    kinds = [pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Ordinary(held.value)
        for batch in batches:
            out = [[] for _ in kinds]
            for t in batch.column(1).to_pylist():
                total, found = 0, []
                for at, size in blocks(words(t)):
                    total += size
                    if (m := measure(at, mine)) is not None:
                        found.append(m)
                for column, value in zip(out, (total, *(zip(*found) if found else [()] * 4))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, total bigint, script array<string>, size array<int>, signs array<int>, doubt array<int>")


def usual_sizes(measured: DataFrame) -> dict[str, float]:
    """Median size per sign of the blocks of each script that has enough of them."""
    b = F.col("b")
    each = measured.select(F.explode(F.arrays_zip("script", "size", "signs")).alias("b")).where(b["signs"] + 1 >= BLOCK // 2)
    each = each.select(b["script"].alias("s"), (F.greatest(b["size"] - BASE, F.lit(0)) / b["signs"]).alias("v"))
    median = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m"))
    return {r["s"]: r["m"] for r in median.where(F.col("n") >= BLOCKS).collect()}  # a row for each script


def fit(documents: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> Ordinary:
    """Common words by language and sizes by script, from all pages."""
    common = common_units(documents, text_col, lang_col)
    return Ordinary(common, usual_sizes(_measured(_texts(documents, text_col, F.lit(0).alias("__id")), common)))


def spam_pages(
    documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str | None = "lang", share: float = SHARE,
    ordinary: Ordinary | None = None,
) -> DataFrame:
    """(id, share): documents whose spam blocks hold over ``share`` of the text.

    Every text is read whole, where it lies: what is shuffled are counts of words. Blocks are measured once, and judged
    when the ordinary sizes are known. Null, empty and blank texts are no cases; a null id and repeated rows stay; labels
    only serve the fit, so wrong ones do no harm; other columns are not read.
    """
    rows = _texts(documents, text_col, F.col(f"`{id_col}`").alias("__id"))
    if ordinary is None:
        common = common_units(documents, text_col, lang_col if lang_col in documents.columns else None)
        measured = materialise(_measured(rows, common), "blocks")
        size = usual_sizes(measured)
    else:
        measured, size = _measured(rows, ordinary.common), ordinary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(2).flatten().dictionary_encode()
            usual = np.array([size.get(x, USUAL) for x in name.dictionary.to_pylist()])
            bytes_, signs, doubt = (batch.column(k).flatten().to_numpy() for k in (3, 4, 5))
            part = np.maximum(0, bytes_ - BASE) / (usual[name.indices.to_numpy()] * signs)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            spam = np.bincount(of, np.where(confirmed(part, doubt), signs + 1, 0), batch.num_rows)
            shares = spam / np.maximum(1, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], [id_col, "share"])

    kind = rows.schema["__id"].dataType.simpleString()
    return measured.mapInArrow(run, f"`{id_col}` {kind}, share double").where(F.col("share") > share)
