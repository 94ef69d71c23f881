"""Runs of consecutive tokens of whole Arrow batches as 64-bit hashes, by array operations over all their signs at once."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs taken at a time; a text is never cut, so a longer one is taken alone.
SIGNS = 2_000_000

_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []

# Code points of scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han).
_UNSPACED = (
    (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FE), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF6F), (0xFF71, 0xFF9D),
    (0x20000, 0x3FFFD),
)

_APART, _WORD, _SINGLE, _MARK, _SINGLE_MARK = range(5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stable(small: np.ndarray) -> np.ndarray:
    """Stable order of non-negative whole numbers, which numpy sorts by digits where they fit into 16 bits."""
    return np.argsort(small.astype(np.uint16) if len(small) and small.max() < 1 << 16 else small, kind="stable")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64th."""
    if not _POWERS or len(_POWERS[0]) < n:
        most = max(n, SIGNS)
        back = pow(_ODD, -1, 1 << 64)
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(most - 1, x, np.uint64)])) for x in (_ODD, back)
        ]
    return _POWERS[0], _POWERS[1]


@lru_cache(maxsize=1)
def _ascii() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(256, np.uint8)
    lower = np.arange(256, dtype=np.uint64)
    for c in range(128):
        kind[c] = _WORD if chr(c).isalnum() else _APART
        lower[c] = ord(chr(c).lower())
    return kind, mix(lower + np.uint64(1))


@lru_cache(maxsize=1)
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint64)
    for c in range(sys.maxunicode + 1):
        group = unicodedata.category(chr(c))[0]
        if group in "LNM":
            kind[c] = _MARK if group == "M" else _WORD
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord("σ" if small == "ς" else small)
    for a, z in _UNSPACED:
        part = kind[a : z + 1]
        part[part == _WORD] = _SINGLE
        part[part == _MARK] = _SINGLE_MARK
    return kind, mix(lower + np.uint64(1))


def _ascii_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs, values by sign, starts, ends, text of each token): longest runs of ASCII letters and digits."""
    kind, value = _ascii()
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = kind[data].astype(bool)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return data, value, starts, ends, np.searchsorted(first, starts, side="right") - 1


def _unit_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of words of any script; of scripts without spaces each sign, with its marks, is a token."""
    kind, value = _unicode()
    data = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kind[data]
    before = np.concatenate([[np.uint8(_APART)], k[:-1]])
    # What a sign continues: of marks, what they stand behind.
    base = np.maximum.accumulate(np.where(k != _MARK, np.arange(len(k)), 0))
    single = np.isin(k[base], (_SINGLE, _SINGLE_MARK)) if len(k) else np.zeros(0, bool)
    after = np.concatenate([[False], single[:-1]])
    start = (k == _SINGLE) | ((k == _SINGLE_MARK) & ~after) | ((k == _WORD) & (after | (before == _APART)))
    start |= (k == _MARK) & (before == _APART)
    starts = np.flatnonzero(start)
    # A token ends where the next begins or the first sign apart stands.
    apart = np.concatenate([np.flatnonzero(k == _APART), [len(k)]])
    ends = np.minimum(apart[np.searchsorted(apart, starts)], np.concatenate([starts[1:], [len(k)]])) if len(starts) else starts
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return data, value, starts, ends, np.searchsorted(first, starts, side="right") - 1


#: How texts may be cut: tokens of ASCII letters and digits, or words of any script.
CUTS: dict[str, Callable] = {"ascii": _ascii_tokens, "units": _unit_tokens}


def token_hashes(texts: list[str | None], cut: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all tokens in order; a null text has none."""
    plain = [(t or "").encode("utf-8", "surrogatepass") for t in texts] if cut == "ascii" else [t or "" for t in texts]
    if not plain:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, values, starts, ends, of = CUTS[cut](plain)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # some SIGNS at a time, however long a text is
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SIGNS, side="right")))
        value, s, e = values[data[base : ends[j - 1]]], starts[i:j] - base, ends[i:j] - base
        up, down = _powers(len(value) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value * up[: len(value)], dtype=np.uint64)])
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out, of


def terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """(tokens in lower case, text of each): longest runs of ASCII letters and digits, in order."""
    plain = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    _, _, starts, ends, of = _ascii_tokens(plain) if plain else (None, None, *[np.zeros(0, np.int64)] * 3)
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    data = np.frombuffer(b"\n".join(plain), np.uint8)[at]
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.string(), len(starts), buffers), of


def term_table(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term, count) of each different token of each text, ``term`` being a place in the last, the tokens."""
    found, of = terms(texts)
    coded = found.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key, tf = np.unique(of * size + coded.indices.to_numpy(), return_counts=True)
    return key // size, key % size, tf, coded.dictionary


def shingles(texts: list[str | None], width: int, cut: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different runs of ``width`` tokens of each text, by text and then by hash."""
    h, of = token_hashes(texts, cut)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = h[:n].copy()
    for k in range(1, width):
        run = mix(run * np.uint64(_ODD) + h[k : k + n])
    whole = of[:n] == of[width - 1 :]
    run, of = run[whole], of[:n][whole]
    order = np.argsort(run)
    order = order[stable(of[order])]
    run, of = run[order], of[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (of[1:] != of[:-1])
    return run[new], of[new]


def slices(batch: pa.RecordBatch, text: int, most: int = SIGNS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to ``most`` bytes in the columns from ``text`` on, or a single row each."""
    if not batch.num_rows:
        return
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[text:])
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
