"""How often every term occurs and in how many records, by burst tries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.runtime import materialise

#: Terms a container holds before it bursts into one container for each next sign.
BURST = 512

#: Terms a task's trie holds before its containers are sent off.
HELD = 300_000

#: Prefixes by which terms are routed: a prefix over a ROUTES-th of all terms' rows is made one sign longer, down to
#: ROUTE_DEPTH signs.
ROUTES, ROUTE_DEPTH = 1024, 6

_TOKEN = re.compile(r"[A-Za-z0-9]+")


class BurstTrie:
    """Occurrence and record counters by term: inner nodes by sign over containers of term remainders.

    An inner node is a dict from a sign to an inner node or a container, which is a list holding one dict; the counters of
    a remainder are occurrences, records and the record counted last.
    """

    __slots__ = ("root", "size", "burst")

    def __init__(self, burst: int = BURST):
        self.root: dict = {}
        self.size, self.burst = 0, burst

    def count(self, tokens: list[str], record: int) -> None:
        """Count the tokens of a record, whose number no other record of this trie has."""
        root = self.root
        for term in tokens:
            node, depth, sign = root, 1, term[:1]
            child = node.get(sign)
            while type(child) is dict:
                node, sign = child, term[depth : depth + 1]
                depth += 1
                child = node.get(sign)
            if child is None:
                child = node[sign] = [{}]
            held, rest = child[0], term[depth:]
            counts = held.get(rest)
            if counts is None:
                self._new(node, sign, held, rest, [1, 1, record])
            else:
                counts[0] += 1
                if counts[2] != record:
                    counts[1] += 1
                    counts[2] = record

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth, sign = self.root, 1, term[:1]
        while type(child := node.get(sign)) is dict:
            node, sign = child, term[depth : depth + 1]
            depth += 1
        if child is None:
            child = node[sign] = [{}]
        self._merge(node, sign, child[0], term[depth:], occurrences, records)

    def _merge(self, node: dict, sign: str, held: dict, rest: str, occurrences: int, records: int) -> None:
        counts = held.get(rest)
        if counts is None:
            self._new(node, sign, held, rest, [occurrences, records, -1])
        else:
            counts[0] += occurrences
            counts[1] += records

    def _new(self, node: dict, sign: str, held: dict, rest: str, counts: list) -> None:
        held[rest] = counts
        self.size += 1
        if len(held) > self.burst and sign:
            inner = node[sign] = {}
            for r, c in held.items():
                inner.setdefault(r[:1], [{}])[0][r[1:]] = c

    def graft(self, prefix: str, rests: list[str], occurrences: list[int], records: list[int]) -> None:
        """Merge a container of another trie: whole where there is nothing yet, counter by counter where one matches it."""
        node = self.root
        for depth, sign in enumerate(prefix):
            child = node.get(sign)
            last = depth == len(prefix) - 1
            if child is None and not last:
                child = node[sign] = {}
            elif child is None:
                node[sign] = [{r: [o, n, -1] for r, o, n in zip(rests, occurrences, records)}]
                self.size += len(rests)
                return
            if type(child) is list:
                if not last:
                    break
                for r, o, n in zip(rests, occurrences, records):
                    if node.get(sign) is child:
                        self._merge(node, sign, child[0], r, o, n)
                    else:  # it burst under the merge
                        self.add(prefix + r, o, n)
                return
            node = child
        for r, o, n in zip(rests, occurrences, records):
            self.add(prefix + r, o, n)

    def containers(self) -> Iterator[tuple[str, dict]]:
        """(prefix, counters by remainder) of each container."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            for sign, child in node.items():
                if type(child) is list:
                    yield prefix + sign, child[0]
                else:
                    todo.append((prefix + sign, child))


def term_counts(records: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, occurrences, records): every token of the texts, how often it occurs and in how many rows.

    A token is a longest run of ASCII letters and digits, lower-cased. Null and empty texts hold none. Each row is a
    record, so drop repeated rows first if they shouldn't count. An empty table gives no rows.

    Each task counts its tokens in one burst trie and sends its containers off whole, at the end or when it holds HELD
    terms. The prefixes by which subtrees are routed adapt to the terms seen: a prefix that would carry over a ROUTES-th
    of the terms is made longer, so that no route, not even one prefix that most terms share, becomes a large task.
    Containers are cut where a longer route runs through them; those of one route meet in one task, which grafts them on
    one trie: where two tasks' containers match they are merged counter by counter. A term comes once from each trie, so
    one found in every record weighs no more than any other.
    """
    texts = records.select(F.col(f"`{text_col}`").alias("text")).where("text is not null and text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, record = BurstTrie(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                trie.count(_TOKEN.findall(text.lower() if text.isascii() else _ascii_lower(text)), record)
                record += 1
                if trie.size > HELD:
                    yield from _send(trie)
                    trie = BurstTrie()
        yield from _send(trie)

    return merge(materialise(texts.mapInArrow(count, _SUBTREES), "tries"))


def _ascii_lower(text: str) -> str:
    """Lower case of the letters of ASCII alone: others may turn into such letters."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}

_SUBTREES = "prefix string, rests array<string>, occurrences array<bigint>, records array<bigint>"


def merge(parts: DataFrame) -> DataFrame:
    """(term, occurrences, records) of all tasks' containers, the subtrees of each route merged in one task."""
    terms = parts.select(F.explode(F.transform("rests", lambda r: F.concat("prefix", r))).alias("term"))
    total = parts.agg(F.sum(F.size("rests"))).first()[0] or 0
    # At most ROUTES prefixes a length: each of them stands for over a ROUTES-th of the terms.
    prefixes = terms.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(ROUTE_DEPTH)), lambda d: F.substring("term", F.lit(1), d))).alias("p"),
        F.length("term").alias("l"),
    ).where(F.length("p") <= F.col("l"))
    often = prefixes.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > total // ROUTES)
    heavy = frozenset(r["p"] for r in often.select("p").collect())

    def route(term: str) -> str:
        return next((p for p in (term[:d] for d in range(1, ROUTE_DEPTH + 1)) if p not in heavy), term)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                prefix = row["prefix"]
                whole = route(prefix)
                if len(whole) <= ROUTE_DEPTH and whole not in heavy:  # no longer route runs through the subtree
                    rows.append((whole, *row.values()))
                    continue
                pieces: dict[str, tuple] = {}
                for r, o, n in zip(row["rests"], row["occurrences"], row["records"]):
                    at = pieces.setdefault(route(prefix + r), ([], [], []))
                    for column, value in zip(at, (r, o, n)):
                        column.append(value)
                rows += [(to, prefix, *columns) for to, columns in pieces.items()]
            names = ["route", "prefix", "rests", "occurrences", "records"]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, mine = BurstTrie(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != mine:
                    yield from _rows(trie)
                    trie, mine = BurstTrie(), row["route"]
                trie.graft(row["prefix"], row["rests"], row["occurrences"], row["records"])
        yield from _rows(trie)

    routed = parts.mapInArrow(cut, "route string, " + _SUBTREES).repartition("route").sortWithinPartitions("route")
    return routed.mapInArrow(join, "term string, occurrences bigint, records bigint")


def _send(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows = [(p, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()]) for p, held in trie.containers()]
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for at in range(0, len(rows), 256):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows[at : at + 256]), kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["prefix", "rests", "occurrences", "records"])


def _rows(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    for prefix, held in trie.containers():
        columns = [pa.array([prefix + r for r in held], pa.string())]
        columns += [pa.array([c[k] for c in held.values()], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "occurrences", "records"])


def marked(counts: DataFrame, n_records: int, fewest: int = 3, share: float = 0.1) -> DataFrame:
    """Counts with ``mark``: rare below ``fewest`` records, common above ``share`` of all records, else null.

    A term that is both is rare.
    """
    mark = F.when(F.col("records") < fewest, "rare").when(F.col("records") > share * n_records + 1e-9 * n_records, "common")
    return counts.withColumn("mark", mark)
