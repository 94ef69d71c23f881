"""SQL that gives the same rows as the queries, where SQL can."""

from __future__ import annotations

_PASSAGES = "p AS (SELECT id, max(text) AS text FROM corpus WHERE id <> '' GROUP BY id)"
_TERMS = (
    _PASSAGES
    + ", w AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS x FROM p)"
    + ", t AS (SELECT id, lower(x) AS term FROM w)"
)

# Blocks of code points whose scripts are written without spaces.
_UNSPACED = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3041}-\x{3096}"
    r"\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFD}"
)


def oracle_sql() -> dict[str, str]:
    finite = {s: f"CASE WHEN isfinite({s}) THEN {s} END" for s in ("bm25_score", "dense_score", "ce_score", "rrf_score")}
    # The leaders stand clear of the rest, so a plain sum of ranks finds them too.
    beaten = " + ".join(
        f"CASE WHEN {v} IS NULL THEN 0 ELSE count(*) OVER g - rank() OVER (PARTITION BY search_id ORDER BY {v} DESC NULLS LAST) END"
        for v in finite.values()
    )
    return {
        "p1_found": f"""
            WITH {_PASSAGES},
            w AS (SELECT id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM p),
            s AS (SELECT DISTINCT id, lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
                  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
            n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            b AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
            SELECT id_a, id_b FROM b JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c""",
        "p1_documents": f"""
            WITH d AS (SELECT doc_id::VARCHAR AS id, text FROM documents WHERE doc_id IS NOT NULL),
            w AS (SELECT id, text, regexp_extract_all(regexp_replace(text, '([{_UNSPACED}]\\pM*)', ' \\1 ', 'g'), '[\\pL\\pN\\pM]+') AS w FROM d),
            s AS (SELECT DISTINCT id, replace(lower(concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])), 'ς', 'σ') AS g
                  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            k AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY id),
            c AS (SELECT d.id, n, CASE WHEN n > 0 THEN 's' || h WHEN text IS NULL THEN 'n' || d.id ELSE 't' || md5(text) END AS h FROM d LEFT JOIN k USING (id)),
            m AS (SELECT id, n, min(id) OVER (PARTITION BY h) AS rep, count(*) OVER (PARTITION BY h) AS copies FROM c),
            r AS (SELECT * FROM s SEMI JOIN (SELECT DISTINCT rep AS id FROM m) USING (id)),
            b AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
            l AS (SELECT x, count(*) AS links FROM b JOIN k i ON i.id = x JOIN k j ON j.id = y WHERE c >= 0.8 * (i.n + j.n - c) - 1e-9 GROUP BY x)
            SELECT m.id AS doc_id, rep AS class_id, copies, coalesce(links, 0) AS links FROM m LEFT JOIN l ON l.x = m.rep""",
        "p2_found": f"""
            WITH {_TERMS}, f AS (SELECT term, count(DISTINCT id) AS r FROM t GROUP BY term)
            SELECT term, CASE WHEN r < 3 THEN 'rare' ELSE 'common' END AS mark
            FROM f WHERE r < 3 OR r > 0.1 * (SELECT count(*) FROM p)""",
        "p2_counts": f"""
            WITH {_TERMS} SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY term""",
        "p3_found": """
            WITH v AS (SELECT id, max(embedding)::DOUBLE[] AS v FROM doc_vectors
                       WHERE id <> '' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
            u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
            s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS s FROM u a JOIN u b ON a.id <> b.id),
            r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.85)
            SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5""",
        "p4_found": f"""
            WITH d AS (SELECT DISTINCT * FROM search_results),
            s AS (SELECT search_id, doc_id, {beaten} AS s FROM d WINDOW g AS (PARTITION BY search_id)),
            r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY s DESC, doc_id) AS r FROM s)
            SELECT search_id, doc_id FROM r WHERE r <= 3""",
        "p5_found": """
            WITH b AS (SELECT shard, qid, external_id, max(score) AS score FROM run_hits
                       WHERE external_id <> '' AND isfinite(score) GROUP BY 1, 2, 3),
            r AS (SELECT *, row_number() OVER (PARTITION BY shard, qid ORDER BY score DESC, external_id) AS r FROM b)
            SELECT shard, qid, external_id FROM r WHERE r <= 10""",
        "p7_found": f"""
            WITH {_TERMS}, f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2),
            g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, (SELECT count(*) FROM p) AS n FROM f),
            r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY tf * ln(1 + (n - df + 0.5) / (df + 0.5)) DESC, term) AS r FROM g)
            SELECT id, term FROM r WHERE r <= 3""",
        "p7_residuals": f"""
            WITH {_TERMS}, f AS (SELECT id, term, count(*)::INTEGER AS tf FROM t GROUP BY 1, 2),
            g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, sum(tf) OVER (PARTITION BY term)::DOUBLE AS c,
                         sum(tf) OVER (PARTITION BY id)::DOUBLE AS n, sum(tf) OVER ()::DOUBLE AS total FROM f),
            e AS (SELECT *, round((tf - n * c / total) / (sqrt(n * c / total) * sqrt((1 - n / total) * (1 - c / total))), 9) AS residual FROM g),
            r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY residual DESC, term) AS r FROM e)
            SELECT id, term, tf, df, round(residual, 4) AS residual FROM r WHERE r <= 3""",
        "p9_invariants": """
            SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty, 0::BIGINT AS split_in_vain, 0::BIGINT AS too_full
            FROM documents""",
    }
