"""Pack texts into containers of fixed capacity without splitting any that fits.

What the driver sees is the histogram of lengths: at most ``capacity`` numbers, however large the collection. A plan
is made of it in two steps. Patterns of few lengths that fill a container are enumerated over coarse length classes,
their repeat counts are fitted to four fifths of each length by non-negative least squares and rounded down; the last two
pieces of a pattern are chosen to fill it to the token. What is left over is packed best-fit, longest first, into the room
that the patterns leave and into new containers. The plan is a table of
ranges ("of length L, numbers s to e go to containers c to c + e - s"); its size depends on the capacity, not on the
collection. The cluster then only numbers the pieces of each length and looks the range up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.runtime import materialise

CAPACITY = 2048

#: Classes of lengths the patterns are made of, and the share of the histogram they are fitted to.
CLASSES, FITTED = 128, 0.8

#: Pieces of one length that are numbered in one task; more are split by hash.
BLOCK = 100_000


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method; ``steps`` bounds how many columns may enter."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    barred: set[int] = set()
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        gain[list(barred)] = -np.inf
        j = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[j] <= tolerance:
            break
        passive[j] = True
        first = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                barred.clear()
                break
            if first and z[at == j] <= 0:  # the column brings nothing after all
                passive[j] = False
                barred.add(j)
                break
            first = False
            low = z <= 0
            shrink = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min(initial=1.0)
            x[at] += shrink * (z - x[at])
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(classes: np.ndarray, units: int, most: int = 6) -> np.ndarray:
    """Rows of counts by class for containers filled to the last unit by at most ``most`` pieces of up to three classes."""
    present, where, rows = sorted(int(c) for c in classes), {int(c): k for k, c in enumerate(classes)}, set()
    for a in present:
        for i in range(1, most + 1):
            rest = units - i * a
            if rest < 0:
                break
            if rest == 0:
                rows.add(((a, i),))
            for b in present:
                if b >= a:
                    break
                for j in range(1, most - i + 1):
                    left = rest - j * b
                    if left < 0:
                        break
                    if left == 0:
                        rows.add(((a, i), (b, j)))
                    elif left < b and left in where and i + j < most:
                        rows.add(((a, i), (b, j), (left, 1)))
    out = np.zeros((len(rows), len(present)))
    for k, row in enumerate(sorted(rows)):
        for c, n in row:
            out[k, where[c]] = n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tally: Callable[[int], None] | None = None) -> tuple[pd.DataFrame, int]:
    """Ranges (length, first, last, container) for a histogram of lengths in 1..capacity, and the number of containers.

    ``tally`` is told how many pieces have a place before best fit begins.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0 and 0 < k <= capacity}
    used: dict[int, int] = defaultdict(int)  # numbers of a length that have a place
    ranges: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first container, how many)
    total = 0

    def place(length: int, first: int, n: int) -> None:
        ranges.append((length, used[length], used[length] + n - 1, first))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def pair(c: int, room: int, length: int, many: int) -> tuple[int, int]:
        """A length of the class, or of one as near as can be, that fills a room to the last token with one more, and how often.

        The length given, if there is none.
        """
        for away in range(units):
            for x in chain(by_class.get(c + away, ()), by_class.get(c - away, ()) if away else ()):
                if (y := room - x) > 0 and left.get(x) and left.get(y, 0) > (x == y):
                    return x, min(many, left[x] // 2 if x == y else left[y])
        return length, many

    # Full containers and the patterns.
    width = max(1, -(-capacity // CLASSES))
    units = capacity // width
    if capacity in left:
        n = left[capacity]
        place(capacity, 0, n)
        total = n
    # A part of each length is kept back: best fit finds exact places for the rest only if it has pieces of all lengths.
    kept: dict[int, int] = {}
    share = 0.0
    for length in sorted(left):
        share += (1 - FITTED) * left[length]
        kept[length] = min(int(share), left[length])
        share -= kept[length]
        left[length] -= kept[length]
        if not left[length]:
            del left[length]
    by_class: dict[int, list[int]] = defaultdict(list)  # lengths of a class, the longest first
    for length in sorted(left, reverse=True):
        if -(-length // width) <= units:
            by_class[-(-length // width)].append(length)
    names = np.array(sorted(by_class, reverse=True), int)
    if len(names):
        shapes = patterns(names, units)
        want = np.array([sum(left[length] for length in by_class[c]) for c in names], float)
        # The fit is relative to the largest class, so that it does not depend on the size of the collection.
        scale = want.max()
        repeats = nnls(shapes.T, want / want.max()) * scale if len(shapes) else np.zeros(0)
        for k in np.argsort(-repeats, kind="stable"):
            have = [sum(left.get(x, 0) for x in by_class[c]) // int(n) for c, n in zip(names, shapes[k]) if n]
            r = min([int(repeats[k] + 1e-9), *have])
            if r <= 0:
                continue
            # Slots take the longest pieces of their class first; runs of equal pieces share ranges. The last two take
            # what fills the room best, of whatever class, so that no room is lost to the width of the classes.
            slots = [c for c, n in zip(names, shapes[k]) for _ in range(int(n))]
            spans = [(total, r, capacity)]
            for i, c in enumerate(slots):
                after = []
                for first, many, room in spans:
                    while many:
                        m = many
                        if i + 1 < len(slots):
                            length = next(x for x in by_class[c] if left.get(x))
                            if i + 2 == len(slots):
                                length, m = pair(c, room, length, many)
                        else:
                            lengths = sorted(left)
                            at = bisect.bisect_right(lengths, room) - 1
                            if at < 0:
                                after.append((first, many, room))
                                break
                            length = lengths[at]
                        m = min(m, left[length])
                        place(length, first, m)
                        after.append((first, m, room - length))
                        first, many = first + m, many - m
                spans = after
            for first, many, room in spans:
                rooms[room].append((first, many))
            total += r

    if tally is not None:
        tally(sum(used.values()))
    for length, n in kept.items():
        if n:
            left[length] = left.get(length, 0) + n

    # The rest: best fit, the longest first.
    sizes = sorted(r for r in rooms if r)
    for length in sorted(left, reverse=True):
        while n := left.get(length, 0):
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                each = capacity // length
                m = max(1, n // each)
                for i in range(min(each, -(-n // m))):
                    place(length, total, min(m, left.get(length, 0)))
                    if length not in left:
                        break
                # All m containers hold i + 1 pieces, the last ones perhaps one less.
                held, short = divmod(n - left.get(length, 0), m)
                for first, many, room in ((total, short, capacity - (held + 1) * length), (total + short, m - short, capacity - held * length)):
                    if many:
                        if room and not rooms[room]:
                            bisect.insort(sizes, room)
                        rooms[room].append((first, many))
                total += m
                continue
            room = sizes[k]
            first, many = rooms[room].pop()
            m = min(n, many)
            place(length, first, m)
            if many > m:
                rooms[room].append((first + m, many - m))
            if not rooms[room]:
                sizes.pop(k)
            if rest := room - length:
                if not rooms[rest]:
                    bisect.insort(sizes, rest)
                rooms[rest].append((first, m))
    table = pd.DataFrame(ranges, columns=["length", "first", "last", "container"]).sort_values(["length", "first"])
    return table.reset_index(drop=True), total


def pack(lengths: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", n_col: str = "n_tokens") -> DataFrame:
    """(id, piece, n_tokens, container): where each text, or each piece of a text over the capacity, goes.

    A text of up to ``capacity`` tokens is one piece, number 0. A longer one gives pieces of ``capacity`` tokens and a
    last one with the rest. A text without tokens (null counts included) takes no room and goes to some container,
    spread over all; if there is none, to container 0. A repeated row is packed once each time; a null id is a text
    like any other. An empty table gives no rows.
    """
    spark = lengths.sparkSession
    n = F.greatest(F.coalesce(F.col(f"`{n_col}`").cast("long"), F.lit(0)), F.lit(0))
    # The row's number settles nothing but which of several equal rows is which.
    rows = lengths.select(F.col(f"`{id_col}`").alias("__id"), n.alias("__n"))
    pieces = rows.select(
        "__id",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("__n") / capacity) - 1).cast("int"))).alias("piece"),
        "__n",
    ).select(
        "__id",
        "piece",
        F.least(F.lit(capacity), F.col("__n") - F.col("piece").cast("long") * capacity).cast("int").alias("__len"),
    )
    pieces = materialise(pieces, "pieces")

    # The driver gets a row for each length: at most capacity + 1.
    histogram = {r["__len"]: r["n"] for r in pieces.groupBy("__len").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, total = plan(histogram, capacity)
    blocks = np.ones(capacity + 1, np.int64)
    for length, n in histogram.items():
        blocks[length] = -(-n // BLOCK)
    several = {length: int(b) for length, b in enumerate(blocks) if b > 1}
    split = F.lit(1)
    if several:
        split = F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for kv in several.items() for x in kv]), F.col("__len")), F.lit(1)
        )
    blocked = pieces.withColumn("__block", F.pmod(F.xxhash64("__id", "piece"), split.cast("long")).cast("int"))

    # Numbers within (length, block), and how many came in the blocks before.
    counts = blocked.groupBy("__len", "__block").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select(
        "__len",
        "__block",
        (F.sum("__c").over(Window.partitionBy("__len").orderBy("__block")) - F.col("__c")).alias("__before"),
    )
    within = F.row_number().over(Window.partitionBy("__len", "__block").orderBy("__id", "piece")) - 1
    numbered = blocked.withColumn("__k", within.cast("long")).join(before, ["__len", "__block"])
    numbered = numbered.select("__id", "piece", "__len", (F.col("__k") + F.col("__before")).alias("__k"))

    ranges = spark.sparkContext.broadcast(
        (table["length"].to_numpy(), table["first"].to_numpy(), table["container"].to_numpy(), total)
    )

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, container, total = ranges.value
        keys = length.astype(np.int64) << 44 | first
        for batch in batches:
            want = batch["__len"].to_numpy().astype(np.int64), batch["__k"].to_numpy().astype(np.int64)
            if len(keys):
                at = np.maximum(np.searchsorted(keys, want[0] << 44 | want[1], side="right") - 1, 0)
                found = container[at] + want[1] - first[at]
            else:
                found = np.zeros(len(batch), np.int64)
            found = np.where(want[0] == 0, want[1] % max(total, 1), found)
            yield pd.DataFrame(
                {id_col: batch["__id"], "piece": batch["piece"], "n_tokens": batch["__len"], "container": found}
            )

    kind = lengths.schema[id_col].dataType.simpleString()
    return numbered.mapInPandas(locate, f"`{id_col}` {kind}, piece int, n_tokens int, container bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of room used, and the fewest containers that could do."""
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("t").alias("tokens"),
        F.max("t").alias("fullest"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * F.lit(capacity)), 4).alias("used"),
        F.ceil(F.sum("t") / F.lit(capacity)).alias("least_containers"),
    )
