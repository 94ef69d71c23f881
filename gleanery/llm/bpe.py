"""Token ids by a byte-level BPE vocabulary file.

A text is cut in three exact steps. (1) A single space between two signs that are not white space always starts a token,
so the text may be cut before it; nearly every such piece was seen before, and its ids come from a bounded table in
the worker. (2) A new piece is cut by the vocabulary's own pattern. (3) A new word is merged over a segment tree whose
leaves are the byte positions and hold the rank of the pair that begins there: the root is the leftmost pair of least
rank, and a merge makes three point updates, so a word of n bytes takes O(n log n) whatever it is made of.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("GLEANERY_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the public pattern by which this vocabulary's texts are cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries a worker's table holds before it starts anew, and the longest piece it holds.
TABLE_ENTRIES, TABLE_SIGNS = 400_000, 96

_APART = re.compile(r"(?<=\S) (?=\S)")
_UNSURE = re.compile(r"\s | \s")


class _Table(dict):
    """Ids by piece; a piece not there is encoded, and kept if it is short."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= TABLE_SIGNS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Encoder over a file of base64 tokens and ranks; the id of a token is its rank."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self._words = regex.compile(PATTERN)
        self._by_word = _Table(self._word)
        self._by_piece = _Table(lambda p: self._piece(" " + p))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, special strings being ordinary text; none for an empty or null one."""
        if not text:
            return []
        pieces = (_APART.split if _UNSURE.search(text) else _split)(text)
        return list(chain(self._piece(pieces[0]), chain.from_iterable(map(self._by_piece.__getitem__, pieces[1:]))))

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._by_word.__getitem__, self._words.findall(piece))))

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else self.merge(raw)

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge the pair of least rank, the leftmost first, until no pair has a rank."""
        ranks, n = self.ranks, len(raw)
        if n < 2:
            return tuple(ranks[raw[i : i + 1]] for i in range(n))
        width = 1 << (n - 1).bit_length()
        none = (len(ranks) + 1) * width
        # A node holds rank * width + position, so the least is the leftmost of the least rank.
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        end = list(range(1, n + 1))  # of the token that begins at a position
        before = list(range(-1, n))  # where the live token before it begins

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least

        def pair(i: int) -> int:
            j = end[i]
            rank = ranks.get(raw[i : end[j]]) if j < n else None
            return none if rank is None else rank * width + i

        while (top := tree[1]) < none:
            i = top & (width - 1)
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)


def _split(text: str) -> list[str]:
    return text.split(" ")


def shipped(spark, path: str) -> str:
    """Hand the vocabulary file to the executors; what it is called there."""
    sent = spark.sparkContext.__dict__.setdefault("_gleanery_vocabularies", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def _local(name: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The worker's encoder, loaded once."""
    return BytePairEncoder(path)


def encode(
    documents: DataFrame, path: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """(id, ids): one row for each row of ``documents``; null and empty texts give an empty list.

    No shuffle: rows are encoded where they are read. A null id stays, repeated rows give a row each, other columns
    are not read.
    """
    rows = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))

    name = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(_local(name))
        for batch in batches:
            for part in _slices(batch, 1):
                flat: list[int] = []
                at = [0]
                for text in part.column(1).to_pylist():
                    flat += bpe.encode(text)
                    at.append(len(flat))
                values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], [id_col, ids])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{ids}` array<int>")


def count_tokens(
    documents: DataFrame, path: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id", n: str = "n_tokens"
) -> DataFrame:
    """(id, number of tokens), as ``encode`` but with the ids left in the worker."""
    rows = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))

    name = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(_local(name))
        for batch in batches:
            for part in _slices(batch, 1):
                counts = [len(bpe.encode(text)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], [id_col, n])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{n}` bigint")


def _slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, for bounded memory."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * most / max(batch.column(text).nbytes, 1)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
