"""Grading of runs against judgements: nDCG, reciprocal rank, recall, average precision."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("nDCG@10", "RR@10", "R@100", "R@1000", "AP")
_CUT = {"nDCG", "RR", "R"}


def parse(measure: str) -> tuple[str, int | None]:
    """("nDCG", 10) of "nDCG@10"; AP takes no cut-off, the others need one."""
    m = re.fullmatch(r"(nDCG|RR|R|AP)(?:@(\d+))?", measure.strip())
    if not m or (m[1] in _CUT) != (m[2] is not None):
        raise ValueError(f"no such measure: {measure}")
    return m[1], int(m[2]) if m[2] else None


def judgements(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, rel) with one row a pair: the highest of repeated judgements, null counting as 0."""
    return qrels.groupBy("qid", "doc_id").agg(F.max(F.greatest(F.coalesce("relevance", F.lit(0)), F.lit(0))).alias("rel"))


def per_query(run: DataFrame, qrels: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(qid, measure, value) for every judged query; one that the run lacks has 0.

    Standard definitions: a document is relevant from 1 on; nDCG takes the relevance as gain and log2(rank + 1) as
    discount, its ideal over all judged documents; recall and AP divide by all relevant ones.
    """
    judged = judgements(qrels)
    ideal = judged.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc())))
    hits = run.select("qid", "doc_id", "rank").join(judged.where("rel > 0"), ["qid", "doc_id"])
    hits = hits.withColumn("found", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    gain = lambda rank: F.col("rel") / F.log2(rank + F.lit(1.0))
    of_ideal, of_run, values = [F.sum((F.col("rel") > 0).cast("int")).alias("n_rel")], [F.lit(None).alias("__")], {}
    for m in measures:
        name, cut = parse(m)
        key = f"{name}_{cut or 0}"
        if name == "nDCG":
            of_ideal.append(F.sum(F.when(F.col("i") <= cut, gain(F.col("i")))).alias(f"ideal_{cut}"))
            of_run.append(F.sum(F.when(F.col("rank") <= cut, gain(F.col("rank")))).alias(key))
            values[m] = F.try_divide(F.col(key), F.col(f"ideal_{cut}"))
        elif name == "RR":
            of_run.append((F.lit(1.0) / F.min(F.when(F.col("rank") <= cut, F.col("rank")))).alias(key))
            values[m] = F.col(key)
        elif name == "R":
            of_run.append(F.sum((F.col("rank") <= cut).cast("double")).alias(key))
            values[m] = F.try_divide(F.col(key), F.col("n_rel"))
        else:
            of_run.append(F.sum(F.col("found") / F.col("rank")).alias(key))
            values[m] = F.try_divide(F.col(key), F.col("n_rel"))
    both = ideal.groupBy("qid").agg(*of_ideal).join(hits.groupBy("qid").agg(*of_run), "qid", "left")
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(v, F.lit(0.0)).alias("value")) for m, v in values.items()])
    return both.select("qid", F.explode(pairs).alias("p")).select("qid", "p.measure", "p.value")


def scorecard(run: DataFrame, qrels: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(measure, value): the mean over judged queries, to 4 decimals."""
    rows = per_query(run, qrels, measures).groupBy("measure").agg(F.round(F.avg("value"), 4).alias("value"))
    return rows.orderBy("measure")


def overlap_at_k(run: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(qid, overlap): the share of the first ``k`` of ``run`` that ``other`` has among its own first ``k``."""
    mine = run.where(F.col("rank") <= k).select("qid", "doc_id")
    theirs = other.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1.0).alias("hit"))
    rows = mine.join(theirs, ["qid", "doc_id"], "left")
    return rows.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("overlap"))
