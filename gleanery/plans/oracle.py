"""SQL that gives the same rows as the queries of the core."""

from __future__ import annotations

from gleanery.plans import retrieval_sql


def oracle_sql() -> dict[str, str]:
    return retrieval_sql.oracle_sql() | {
        "p6_found": """
            WITH n AS (SELECT shard, term, count(DISTINCT doc_id) AS n FROM postings WHERE doc_id IS NOT NULL AND tf > 0 GROUP BY 1, 2),
            e AS (SELECT DISTINCT shard, term, df FROM term_entries)
            SELECT coalesce(n.shard, e.shard) AS shard, coalesce(n.term, e.term) AS term
            FROM n FULL JOIN e ON n.shard = e.shard AND n.term = e.term WHERE coalesce(n, 0) <> coalesce(df, 0)""",
    }
