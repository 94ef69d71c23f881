"""How characteristic a term is of its record: correspondence-analysis residuals and tf x idf."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scoring import idf
from gleanery.llm.shingles import slices, term_table
from gleanery.runtime import fits_broadcast, join_per_key, materialise

_COLUMNS = ["id", "term", "tf", "df", "tfidf", "residual", "rank"]


def term_margins(records: DataFrame) -> DataFrame:
    """(term, df, c): in how many records a term is, and how often; each batch of (id, text) rows is counted where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                _, term, tf, known = term_table(part.column(0).to_pylist())
                df, c = np.bincount(term, minlength=len(known)), np.bincount(term, tf, minlength=len(known))
                yield pa.RecordBatch.from_arrays([known, pa.array(df, pa.int64()), pa.array(c.astype(np.int64))], ["term", "df", "c"])

    parts = records.select("text").mapInArrow(run, "term string, df bigint, c bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("c").alias("c"))


def postings(records: DataFrame) -> DataFrame:
    """(id, n, term, tf): the terms of each record, n being all its tokens. Counted within the row: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                of, term, tf, known = term_table(part.column(1).to_pylist())
                n = np.bincount(of, tf, minlength=part.num_rows).astype(np.int64)
                columns = [part.column(0).take(pa.array(of)), pa.array(n[of]), known.take(pa.array(term)), pa.array(tf, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "term", "tf"])

    kind = records.schema["id"].dataType.simpleString()
    return records.select("id", "text").mapInArrow(run, f"id {kind}, n bigint, term string, tf int")


def distinctiveness(records: DataFrame, n_records: int, n: int = 3, by: str = "tfidf") -> DataFrame:
    """(id, term, tf, df, tfidf, residual, rank): for each record its ``n`` most characteristic terms.

    ``records`` is (id, text) with distinct ids. ``by`` is "residual" or "tfidf"; ties go by ascending term; fewer
    than ``n`` terms: all of them; a null or empty text has none; an empty table gives no rows.

    The residual is that of correspondence analysis: with row margin r (tokens of the record), column margin c
    (occurrences of the term) and all tokens T, expected count e = r c / T, it is (tf - e) / sqrt(e), adjusted for its
    variance by sqrt((1 - r / T) (1 - c / T)). Where a margin is the whole table the residual is 0. Residuals are
    rounded to 9 decimals before they are ranked.

    Where the margins of all terms were measured to fit, they are broadcast and each record is scored and ranked where it
    lies, so only ``n`` rows of it leave the task. Else its terms are joined to them: the terms that hold more than a
    task's fair share of the rows, at most four for each partition, are broadcast and the rest is joined by term, so that
    no term's rows meet in one task.
    """
    per_term = materialise(term_margins(records), "margins")
    total = float(per_term.agg(F.sum("c")).first()[0] or 1)
    if fits_broadcast(per_term, 64, "term"):
        return _in_place(records, per_term.toArrow(), float(n_records), total, n, by)
    table = materialise(postings(records), "terms")
    joined = join_per_key(table, per_term, "term", "df", table.count())
    e = F.col("n") * F.col("c") / F.lit(total)
    margins = (1 - F.col("n") / F.lit(total)) * (1 - F.col("c") / F.lit(total))
    residual = F.coalesce(F.try_divide(F.col("tf") - e, F.sqrt(e) * F.sqrt(margins)), F.lit(0.0))
    tfidf = F.col("tf") * idf(F.lit(float(n_records)), F.col("df").cast("double"))
    scored = joined.select("id", "term", "tf", "df", tfidf.alias("tfidf"), F.round(residual, 9).alias("residual"))
    order = Window.partitionBy("id").orderBy(F.col(by).desc(), F.col("term").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(_COLUMNS)


def _in_place(records: DataFrame, margins: pa.Table, n_records: float, total: float, n: int, by: str) -> DataFrame:
    margins = margins.combine_chunks()
    held = records.sparkSession.sparkContext.broadcast([margins.column(k).to_numpy() for k in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        names, dfs, cs = held.value
        index = pd.Index(names)
        for batch in batches:
            for part in slices(batch, 1):
                of, term, tf, known = term_table(part.column(1).to_pylist())
                at = index.get_indexer(known.to_numpy(zero_copy_only=False))[term]
                df, c, r = dfs[at], cs[at], np.bincount(of, tf, minlength=part.num_rows)[of]
                e = r * c / total
                spread = np.sqrt(e) * np.sqrt((1 - r / total) * (1 - c / total))
                residual = np.round(np.divide(tf - e, spread, out=np.zeros(len(tf)), where=spread > 0), 9)
                tfidf = tf * np.log(1 + (n_records - df + 0.5) / (df + 0.5))
                # Places of the terms in their order settle ties.
                place = np.empty(len(known), np.int64)
                place[pc.sort_indices(known).to_numpy()] = np.arange(len(known))
                order = np.lexsort((place[term], -(tfidf if by == "tfidf" else residual), of))
                first = np.searchsorted(of, of, side="left")  # of one record are next to each other, ordered or not
                rank = np.arange(len(of)) - first + 1
                order, rank = order[rank <= n], rank[rank <= n]
                columns = [part.column(0).take(pa.array(of[order])), known.take(pa.array(term[order])), pa.array(tf[order], pa.int32())]
                columns += [pa.array(x[order]) for x in (df, tfidf, residual)] + [pa.array(rank, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    kind = records.schema["id"].dataType.simpleString()
    return records.select("id", "text").mapInArrow(
        run, f"id {kind}, term string, tf int, df bigint, tfidf double, residual double, rank int"
    )
