"""Column expressions of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 0.9, 0.4, 60


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)): positive for every df up to N."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """tf part of BM25; all zero lengths (avgdl 0) count as average length."""
    length = F.coalesce(F.try_divide(dl, avgdl), F.lit(1.0))
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length))


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def varint_size(v: Column) -> Column:
    """Bytes of an unsigned number at seven bits a byte."""
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5)


def bar(v: Column, low: Column, high: Column) -> Column:
    """Length of a score bar between 0.04 and 1; 0 where the score is missing."""
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return (
        F.when(~usable, 0.0)
        .when(high <= low, 1.0)
        .otherwise(F.greatest(F.lit(0.04), F.least(F.lit(1.0), (v - low) / (high - low))))
    )
