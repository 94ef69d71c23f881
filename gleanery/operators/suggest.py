"""Completion of prefixes and correction of words over a vocabulary of (term, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from gleanery.functions.text import as_bytes, deletes, tokens
from gleanery.runtime import materialise, parallelism, shuffle_partitions

MAX_EDIT = 2


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, weight): every token with its occurrences in the collection."""
    words = texts.select(F.explode(tokens(F.col(f"`{text_col}`"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("weight"))


def add_terms(vocab: DataFrame, more: DataFrame) -> DataFrame:
    """Weights of repeated terms add up; empty terms and weights under 1 are ignored."""
    rows = vocab.select("term", "weight").unionByName(more.select("term", "weight")).where("term <> '' and weight > 0")
    return rows.groupBy("term").agg(F.sum("weight").alias("weight"))


def complete(vocab: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """(term, weight): the heaviest terms with a prefix, itself included; all terms have the empty one."""
    found = vocab.where(F.col("term").startswith(prefix))
    return found.orderBy(F.col("weight").desc(), F.col("term")).limit(max(k, 0)).select("term", "weight")


def complete_all(vocab: DataFrame, prefixes: DataFrame, k: int = 8) -> DataFrame:
    """(prefix, term, weight, rank) for a column ``prefix``: terms meet prefixes of their own length by equality."""
    wanted = prefixes.select("prefix").where("prefix is not null").distinct()
    lengths = [r[0] for r in wanted.select(F.length("prefix").alias("n")).distinct().collect()]  # a few lengths
    starts = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths]) if lengths else F.array()
    cut = vocab.select("term", "weight", F.explode(starts.cast("array<string>")).alias("prefix")).where("prefix is not null")
    order = Window.partitionBy("prefix").orderBy(F.col("weight").desc(), F.col("term"))
    ranked = cut.join(wanted, "prefix").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("prefix", "term", "weight", "rank")


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions, swaps of neighbours; nothing is edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def osa_all(a: list[str], b: list[str]) -> np.ndarray:
    """``osa`` of many pairs at once: the table of all of them is filled cell by cell, pairs of like length together."""
    out = np.zeros(len(a), np.int32)
    size = np.maximum([len(x) for x in a], [len(x) for x in b]) if len(a) else out
    group = np.ceil(np.maximum(size, 1) / 4).astype(int)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        x, y = (np.array([s[i] for i in at], f"U{4 * g}") for s in (a, b))
        out[at] = _table(*(z.view(np.uint32).reshape(len(at), -1) for z in (x, y)), np.char.str_len(x), np.char.str_len(y))
    return out


def _table(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    width = y.shape[1] + 1
    older = before = None
    row = np.tile(np.arange(width, dtype=np.int32)[:, None], (1, len(x)))
    out = np.where(n == 0, m, 0).astype(np.int32)
    for i in range(1, x.shape[1] + 1):
        older, before, row = before, row, np.empty_like(row)
        row[0] = i
        for j in range(1, width):
            differs = x[:, i - 1] != y[:, j - 1]
            best = np.minimum(np.minimum(before[j], row[j - 1]) + 1, before[j - 1] + differs)
            if i > 1 and j > 1:
                swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swapped, np.minimum(best, older[j - 2] + 1), best)
            row[j] = best
        done = np.flatnonzero(n == i)
        out[done] = row[m[done], done]
    return out


@F.pandas_udf(IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(osa_all(a.tolist(), b.tolist()))


def distance(a: Column, b: Column) -> Column:
    """Optimal string alignment over bytes."""
    return _osa(as_bytes(a), as_bytes(b))


def delete_index(vocab: DataFrame, max_edit: int = MAX_EDIT) -> DataFrame:
    """(variant, term): what is left of each term after up to ``max_edit`` deletions.

    A term gives about half its length squared of variants, so the terms are spread before: a vocabulary is small, and
    what its aggregation leaves is often one partition.
    """
    spark = vocab.sparkSession
    wide = vocab.repartition(max(parallelism(spark), shuffle_partitions(spark)), "term")
    return wide.select("term", F.explode(deletes(as_bytes(F.col("term")), max_edit)).alias("variant"))


def candidates(vocab: DataFrame, words: DataFrame, max_edit: int = MAX_EDIT) -> DataFrame:
    """(word, term): terms that share a variant with a word of the column ``word``.

    Words are distinct, not null and not empty here. Only terms within ``max_edit`` of a word's length are expanded.
    """
    wanted = words.select("word").where("word is not null and word <> ''").distinct()
    lengths = wanted.select(F.octet_length("word").alias("n")).distinct().collect()
    near = sorted({r["n"] + i for r in lengths for i in range(-max_edit, max_edit + 1)})
    able = vocab.where(F.octet_length("term").isin(near)) if near else vocab.limit(0)
    mine = wanted.select("word", F.explode(deletes(as_bytes(F.col("word")), max_edit)).alias("variant"))
    return mine.join(delete_index(able, max_edit), "variant").select("word", "term").distinct()


def correct_all(vocab: DataFrame, words: DataFrame, k: int = 5, max_edit: int = MAX_EDIT) -> DataFrame:
    """(word, term, distance, weight, rank): the ``k`` nearest terms of each word, then the heaviest, then by term.

    A word without any within ``max_edit`` has no rows.
    """
    vocab = materialise(vocab.select("term", "weight"), "vocabulary")
    words = materialise(words.select("word").where("word is not null and word <> ''").distinct(), "words")
    pairs = candidates(vocab, words, max_edit)
    # A swap is two plain edits, so what is further apart than twice the limit needs no alignment.
    near = pairs.where(F.levenshtein(as_bytes(F.col("word")), as_bytes(F.col("term")), 2 * max_edit) >= 0)
    far = near.withColumn("distance", distance(F.col("word"), F.col("term")))
    rows = far.where(F.col("distance") <= max_edit).join(vocab, "term")
    order = Window.partitionBy("word").orderBy("distance", F.col("weight").desc(), "term")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("word", "term", "distance", "weight", "rank")


def correct_queries(vocab: DataFrame, queries: DataFrame, max_edit: int = MAX_EDIT) -> DataFrame:
    """(qid, corrected): queries in which words were replaced, null where none was.

    Words are what white space leaves, marks attached; each is looked up in lower case and replaced only by a term at a
    distance above 0, so that known words keep their case. A qid that repeats counts with its greatest text.
    """
    one = queries.where("qid is not null").groupBy("qid").agg(F.max("query").alias("query"))
    words = F.filter(F.split(F.coalesce("query", F.lit("")), r"\s+"), lambda x: x != "")
    each = one.select("qid", F.posexplode_outer(words).alias("p", "w")).withColumn("word", F.lower("w"))
    best = correct_all(vocab, each.select("word"), 1, max_edit).where("distance > 0").select("word", "term")
    fixed = each.join(best, "word", "left").groupBy("qid").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("term", "w").alias("w")))), lambda x: x["w"])).alias("t"),
        F.count("term").alias("n"),
    )
    return fixed.select("qid", F.when(F.col("n") > 0, F.col("t")).alias("corrected"))


def accuracy(vocab: DataFrame, pairs: DataFrame, max_edit: int = MAX_EDIT) -> DataFrame:
    """One row (pairs, correct, percent) for (typo, expected) pairs; raises ValueError if there are none."""
    pairs = pairs.select("typo", "expected")
    if pairs.isEmpty():
        raise ValueError("no pairs")
    best = correct_all(vocab, pairs.select(F.col("typo").alias("word")), 1, max_edit).select(F.col("word").alias("typo"), "term")
    right = (F.col("term") == F.col("expected")).cast("int")
    return pairs.join(best, "typo", "left").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.coalesce(right, F.lit(0))).alias("correct"),
        F.round(F.avg(F.coalesce(right, F.lit(0)).cast("double")) * 100, 4).alias("percent"),
    )


def message(word: str, found: list[tuple[str, int]]) -> str:
    """What to tell of a word and its (term, distance) suggestions."""
    if not found:
        return f"{word}: no suggestion"
    if found[0][1] == 0:
        return f"{word}: spelled correctly"
    others = ", ".join(t for t, _ in found[1:])
    return f"{word}: did you mean {found[0][0]}?" + (f" (others: {others})" if others else "")


def intent(line: str, known) -> tuple[str, str]:
    """("complete" | "correct", text) of a typed line: ``x*`` and known words complete, ``?x`` and others correct."""
    line = line.strip()
    if line.endswith("*"):
        return "complete", line[:-1]
    if line.startswith("?"):
        return "correct", line[1:]
    return ("complete" if known(line) else "correct"), line
