"""Unsigned numbers as bytes of seven bits, the lowest first; the top bit says that more follow."""

from __future__ import annotations

import numpy as np


def encode(values) -> bytes:
    """All of ``values``, which are at least 0 and under 2**32, one after another."""
    v = np.asarray(values, dtype=np.uint64)
    if not len(v):
        return b""
    if v.max() >> np.uint64(32):
        raise ValueError("over 32 bits")
    sevens = (v[:, None] >> np.arange(0, 35, 7, dtype=np.uint64)) & np.uint64(127)
    size = np.maximum(1, 5 - (sevens[:, ::-1] != 0).argmax(axis=1))
    size[v == 0] = 1
    place = np.arange(5)[None, :]
    more = np.where(place < size[:, None] - 1, np.uint64(128), np.uint64(0))
    return (sevens | more)[place < size[:, None]].astype(np.uint8).tobytes()


def sizes(values) -> np.ndarray:
    """Bytes that ``encode`` takes for each of the values."""
    v = np.asarray(values, np.uint64)
    return 1 + sum((v >> np.uint64(b) != 0).astype(np.int64) for b in (7, 14, 21, 28))


def decode(raw: bytes) -> list[int]:
    """The numbers of ``raw``; ValueError where it breaks off or a number is too long."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(b) and (not len(ends) or ends[-1] != len(b) - 1):
        raise ValueError("broken off")
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    if len(ends) and (ends - begins).max() > 4:
        raise ValueError("over five bytes")
    shift = np.arange(len(b)) - np.repeat(begins, ends - begins + 1)
    parts = (b.astype(np.uint64) & np.uint64(127)) << (shift.astype(np.uint64) * np.uint64(7))
    return np.add.reduceat(parts, begins).tolist() if len(ends) else []


def pack_postings(doc_ids, tfs) -> bytes:
    """A posting list as gap and tf of each document, by ascending number."""
    ids = np.asarray(doc_ids, np.int64)
    order = np.argsort(ids, kind="stable")
    gaps = np.diff(ids[order], prepend=0)
    return encode(np.stack([gaps, np.asarray(tfs, np.int64)[order]], axis=1).ravel())


def unpack_postings(raw: bytes) -> list[tuple[int, int]]:
    flat = np.array(decode(raw), np.int64).reshape(-1, 2)
    return list(zip(np.cumsum(flat[:, 0]).tolist(), flat[:, 1].tolist()))
