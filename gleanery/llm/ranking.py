"""One ranking from several scores on different scales, by closeness to an ideal point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.corpus import finite

#: Scores beyond the quartiles by more than this many quartile distances are pulled in to that fence.
FENCE = 1.0


def ideal_point(
    rows: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, fence: float = FENCE
) -> DataFrame:
    """(group, item, closeness, rank): the items of each group by relative closeness to the ideal point.

    Each score is winsorised at its fences, ``fence`` quartile distances beyond the quartiles of its group, moved so that
    a missing or non-finite one is 0 and the least present one a step above it, and vector-normalised: divided by the
    length of the group's vector of that score, per root of the results that have it. The ideal point has the greatest
    value of each score, the anti-ideal one 0; distances to both are weighted by ``weights``, all 1 by default.
    Closeness is d(anti-ideal) / (d(ideal) + d(anti-ideal)). A score
    missing in a whole group does not count; if all are, the closeness is 0 and the order that of the items. Ties go by
    ascending item. (group, item) rows that repeat count once, with the greatest of each score. A null group is a group;
    rows with a null item don't count; other columns are not read.

    Quartiles, extremes and norms are mergeable aggregates, so a group of any size is summarised without being brought
    to one task: quartiles are exact up to 10,000 items and within 1/10,000 of the ranks beyond. The summaries are
    joined back to the rows by group, twice, as norms are of winsorised scores; AQE splits a large group there. The rank is over the whole group, so ask
    ``leaders`` for the first few: its window is limited before the shuffle.
    """
    return _ranked(_closeness(rows, group, item, scores, weights, fence), group, item)


def leaders(rows: DataFrame, group: str, item: str, scores: list[str], n: int = 3, **kw) -> DataFrame:
    """The first ``n`` of each group by ``ideal_point``; each task drops what can't be among them before the shuffle."""
    return ideal_point(rows, group, item, scores, **kw).where(F.col("rank") <= n)


def _ranked(scored: DataFrame, group: str, item: str) -> DataFrame:
    order = Window.partitionBy("__g").orderBy(F.col("closeness").desc(), F.col("__i").asc())
    return scored.withColumn("rank", F.row_number().over(order)).select(
        F.col("__g").alias(group), F.col("__i").alias(item), "closeness", "rank"
    )


def _closeness(rows, group, item, scores, weights, fence) -> DataFrame:
    weights = weights or [1.0] * len(scores)
    named = [f"s{k}" for k in range(len(scores))]
    clean = rows.select(
        F.col(f"`{group}`").alias("__g"),
        F.col(f"`{item}`").alias("__i"),
        *[finite(F.col(f"`{s}`")).alias(n) for s, n in zip(scores, named)],
    ).where("__i is not null")
    clean = clean.groupBy("__g", "__i").agg(*[F.max(n).alias(n) for n in named])

    quartiles = clean.groupBy("__g").agg(
        *[F.percentile_approx(n, [0.25, 0.75], 10_000).alias(f"q_{n}") for n in named],
        *[F.min(n).alias(f"lo_{n}") for n in named],
        *[F.max(n).alias(f"hi_{n}") for n in named],
        *[F.count(n).alias(f"n_{n}") for n in named],
    )
    limits = ["__g"]
    for n in named:
        q1, q3 = F.col(f"q_{n}")[0], F.col(f"q_{n}")[1]
        low = F.greatest(F.col(f"lo_{n}"), q1 - fence * (q3 - q1))
        high = F.least(F.col(f"hi_{n}"), q3 + fence * (q3 - q1))
        step = F.when(high > low, (high - low) / F.col(f"n_{n}")).otherwise(F.lit(1.0))
        limits += [low.alias(f"low_{n}"), high.alias(f"high_{n}"), step.alias(f"step_{n}")]
    limits = quartiles.select(*limits)
    limits = limits.withColumnRenamed("__g", "__h")
    joined = clean.join(limits, F.col("__g").eqNullSafe(F.col("__h"))).drop("__h")
    # Winsorised and moved: a missing score is 0, the least present one a step.
    moved = []
    for n in named:
        low, high, step = F.col(f"low_{n}"), F.col(f"high_{n}"), F.col(f"step_{n}")
        inside = F.least(F.greatest(F.col(n), low), high) - low + step
        moved += [F.when(F.col(n).isNotNull(), inside).alias(n), (high - low + step).alias(f"top_{n}")]
    moved = joined.select("__g", "__i", *moved)
    # The length of each score's vector over the root of how many results have it.
    norms = moved.groupBy("__g").agg(*[F.sqrt(F.avg(F.col(n) * F.col(n))).alias(f"norm_{n}") for n in named])
    normed = moved.join(norms.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h")))
    ideal = anti = F.lit(0.0)
    for n, w in zip(named, weights):
        value = F.coalesce(F.lit(float(w)) * F.col(n) / F.col(f"norm_{n}"), F.lit(0.0))
        best = F.coalesce(F.lit(float(w)) * F.col(f"top_{n}") / F.col(f"norm_{n}"), F.lit(0.0))
        ideal = ideal + (best - value) * (best - value)
        anti = anti + value * value
    ideal, anti = F.sqrt(ideal), F.sqrt(anti)
    closeness = F.coalesce(F.try_divide(anti, ideal + anti), F.lit(0.0))
    # To nine decimals: sums of squares differ in their last bits.
    return normed.select("__g", "__i", F.round(closeness, 9).alias("closeness"))
