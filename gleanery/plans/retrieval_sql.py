"""DuckDB SQL of the retrieval queries, composed of common table expressions."""

from __future__ import annotations

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
CE = {
    "p": "SELECT id AS doc_id, max(text) AS text, min(shard) AS shard FROM corpus WHERE id <> '' GROUP BY id",
    "q": "SELECT qid, max(query) AS query FROM queries WHERE qid IS NOT NULL GROUP BY qid",
    "w": "SELECT doc_id, shard, {t} AS w FROM p".format(t=TOKENS.format("coalesce(text, '')")),
    "o": "SELECT doc_id, shard, len(w) AS dl, unnest(w) AS term FROM w",
    "post": "SELECT term, doc_id, shard, dl, count(*)::INTEGER AS tf FROM o GROUP BY ALL",
    "stats": "SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w",
    "terms": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf, min(dl) AS min_dl FROM post GROUP BY term",
    "vocab": "SELECT term, count(*) AS weight FROM o GROUP BY term",
    "qo": f"SELECT qid, unnest({TOKENS.format('query')}) AS term FROM q",
    "qt": "SELECT qid, term, count(*) AS qtf FROM qo GROUP BY ALL",
    "words": "SELECT DISTINCT term AS word FROM qo",
    "idfs": "SELECT term, df, max_tf, min_dl, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM terms, stats",
    "hits": "SELECT qid, doc_id, round(sum(qtf * {i}), 6) AS score FROM qt JOIN post USING (term) JOIN idfs USING (term) GROUP BY ALL",
    "ranked": "SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM hits",
    "lg": """SELECT qid, external_id AS doc_id, round(max(score), 6) AS score FROM run_hits
             WHERE external_id <> '' AND isfinite(score) GROUP BY ALL""",
    "logged": "SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM lg QUALIFY rank <= 200",
    "judged": "SELECT qid, doc_id, max(greatest(coalesce(relevance, 0), 0)) AS rel FROM qrels GROUP BY ALL",
    "valid": "SELECT shard, term, doc_id, max(tf) AS tf FROM postings WHERE doc_id IS NOT NULL AND tf > 0 GROUP BY ALL",
    "gapped": "SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY shard, term ORDER BY doc_id), 0) AS gap FROM valid",
}
NEEDS = {
    "w": "p", "o": "w", "post": "o", "stats": "w", "terms": "post", "vocab": "o", "qo": "q", "qt": "qo", "words": "qo",
    "idfs": "terms stats", "hits": "qt post idfs", "ranked": "hits", "logged": "lg", "gapped": "valid",
}


def impact(k1: float = 0.9, b: float = 0.4, tf: str = "tf", dl: str = "dl") -> str:
    return f"idf * {tf} * ({k1} + 1.0) / ({tf} + {k1} * (1.0 - {b} + {b} * {dl} / avgdl))"


def with_(names: str, select: str, k1: float = 0.9, b: float = 0.4, **more: str) -> str:
    """``select`` after the named expressions and all they need; ``more`` come last, in their order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, "").split():
            add(need)
        done.setdefault(name, CE[name].replace("{i}", impact(k1, b)))

    for name in names.split():
        add(name)
    done |= more
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + select


def varint(v: str) -> str:
    return f"CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 WHEN {v} < 2097152 THEN 3 WHEN {v} < 268435456 THEN 4 ELSE 5 END"


# Optimal string alignment from the unrestricted distance, up to 2: a swapped pair with one sign put between is 3.
def _between(a: str, b: str) -> str:
    return f"""(length({b}) = length({a}) + 1 AND len(list_filter(range(1, length({a})), lambda i:
        substr({a}, 1, i - 1) = substr({b}, 1, i - 1) AND substr({a}, i + 2) = substr({b}, i + 3)
        AND substr({a}, i, 1) = substr({b}, i + 2, 1) AND substr({a}, i + 1, 1) = substr({b}, i, 1))) > 0)"""


def _deletes(table: str, column: str, rounds: int) -> dict[str, str]:
    out = {f"{table}_d0": f"SELECT DISTINCT {column}, {column} AS variant FROM {table}"}
    for r in range(1, rounds + 1):
        out[f"{table}_d{r}"] = f"""SELECT {column}, variant FROM {table}_d{r - 1} UNION
            SELECT {column}, substr(variant, 1, i - 1) || substr(variant, i + 1) AS variant
            FROM (SELECT {column}, variant, unnest(range(1, length(variant) + 1)) AS i FROM {table}_d{r - 1} WHERE length(variant) > 1)"""
    return out


_SPELL = {
    **_deletes("words", "word", 2),
    **_deletes("vocab", "term", 2),
    "cand": "SELECT DISTINCT word, term FROM words_d2 JOIN vocab_d2 USING (variant)",
    "far": f"""SELECT word, term, damerau_levenshtein(word, term) AS distance FROM cand
               WHERE damerau_levenshtein(word, term) <= 2 AND NOT (damerau_levenshtein(word, term) = 2
                 AND ({_between("word", "term")} OR {_between("term", "word")}))""",
    "near": """SELECT word, term, distance::INTEGER AS distance, weight,
               (row_number() OVER (PARTITION BY word ORDER BY distance, weight DESC, term))::INTEGER AS rank FROM far JOIN vocab USING (term)""",
}

_RRF = """SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(run * 1000000 + rank) AS first FROM runs GROUP BY ALL"""
_FUSED = "SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, doc_id))::INTEGER AS rank FROM summed"
_TWO = {
    "runs": "SELECT qid, doc_id, rank, 0 AS run FROM ranked WHERE rank <= 200 UNION ALL SELECT qid, doc_id, rank, 1 FROM logged",
    "summed": _RRF,
    "every": _FUSED,
}
_CE = f"""CASE WHEN query IS NOT NULL THEN round(coalesce(
    len(list_intersect(list_distinct({TOKENS.format("query")}), list_distinct({TOKENS.format("coalesce(text, '')")})))::DOUBLE
    / nullif(len(list_distinct({TOKENS.format("query")})), 0), 0), 6) END"""

_SCORES = ["bm25_score", "dense_score", "ce_score", "rrf_score"]


def _graded(value: str, name: str) -> str:
    return with_(
        "ranked judged",
        f"""SELECT i.qid, '{name}' AS measure, round(coalesce({value}, 0.0), 6) AS value FROM ideal i LEFT JOIN got USING (qid)""",
        **_GRADED,
    )


_GRADED = {
    "ij": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM judged",
    "ideal": """SELECT qid, sum((rel > 0)::INTEGER) AS n_rel, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) END) AS idcg FROM ij GROUP BY qid""",
    "h": """SELECT qid, rank, rel, row_number() OVER (PARTITION BY qid ORDER BY rank) AS found
            FROM ranked JOIN judged USING (qid, doc_id) WHERE rank <= 1000 AND rel > 0""",
    "got": """SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) AS dcg,
              1.0 / min(CASE WHEN rank <= 10 THEN rank END) AS rr, sum((rank <= 100)::INTEGER) AS r100,
              count(*) AS r1000, sum(found::DOUBLE / rank) AS ap FROM h GROUP BY qid""",
}
_MEASURES = {
    "nDCG@10": "dcg / nullif(idcg, 0)",
    "RR@10": "rr",
    "R@100": "r100 / nullif(n_rel, 0)",
    "R@1000": "r1000 / nullif(n_rel, 0)",
    "AP": "ap / nullif(n_rel, 0)",
}


def _sharded() -> dict[str, str]:
    return {
        "ss": "SELECT shard, count(*) AS n, avg(len(w)) AS avgdl FROM w GROUP BY shard",
        "st": "SELECT shard, term, count(*) AS df FROM post GROUP BY ALL",
        "si": "SELECT shard, term, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM st JOIN ss USING (shard)",
        "sh": f"""SELECT qid, doc_id, shard, round(sum(qtf * {impact()}), 6) AS score
                  FROM qt JOIN post USING (term) JOIN si USING (shard, term) GROUP BY ALL""",
        "sr": "SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sh QUALIFY rank <= 10",
    }


def oracle_sql() -> dict[str, str]:
    top10 = "SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 10"
    fin = {s: f"CASE WHEN isfinite({s}) THEN {s} END" for s in _SCORES}
    ranges = ", ".join(f"coalesce(min({v}), 0.0) AS low_{s}, coalesce(max({v}), 1.0) AS high_{s}" for s, v in fin.items())
    bars = ", ".join(
        f"""round(CASE WHEN {v} IS NULL THEN 0.0 WHEN high_{s} <= low_{s} THEN 1.0
            ELSE greatest(0.04, least(1.0, ({s} - low_{s}) / (high_{s} - low_{s}))) END, 6) AS bar_{s}"""
        for s, v in fin.items()
    )
    one = {
        "asked": f"""SELECT doc_id, round(sum(qtf * {impact()}), 6) AS score FROM
                (SELECT unnest(['how', 'does', 'the', 'protein', 'change', 'market']) AS term, unnest([1, 1, 2, 1, 1, 1]) AS qtf)
                JOIN post USING (term) JOIN idfs USING (term) GROUP BY doc_id""",
        "top": "SELECT doc_id, score, (row_number() OVER (ORDER BY score DESC, doc_id))::INTEGER AS rank FROM asked QUALIFY rank <= 10",
    }
    single = with_("post idfs", "SELECT * FROM top", **one)
    reranked = {
        **_TWO,
        "cut": "SELECT * FROM every WHERE rank <= 1000",
        "head": f"""SELECT c.qid, c.doc_id, rank AS old, {_CE} AS ce FROM cut c LEFT JOIN q USING (qid) LEFT JOIN p USING (doc_id)
                    WHERE rank <= 50 AND (query IS NULL OR p.doc_id IS NOT NULL)""",
        "parts": "SELECT qid, doc_id, old, ce FROM head UNION ALL SELECT qid, doc_id, rank, NULL FROM cut WHERE rank > 50",
        "opened": "SELECT *, bool_or(old <= 50 AND ce IS NULL) OVER (PARTITION BY qid) AS open, min(ce) OVER (PARTITION BY qid) AS least, count(ce) OVER (PARTITION BY qid) AS heads, (row_number() OVER (PARTITION BY qid ORDER BY ce DESC NULLS LAST, old))::INTEGER AS rank FROM parts",
    }
    funnel = {
        **_TWO,
        "cut": "SELECT * FROM every WHERE rank <= 1000",
        "scored": f"SELECT c.qid, c.doc_id, c.score AS rrf_score, rank AS rrf_rank, CASE WHEN rank <= 50 THEN {_CE} END AS ce_score FROM cut c LEFT JOIN q USING (qid) LEFT JOIN p USING (doc_id)",
        "final": "SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY ce_score DESC NULLS LAST, rrf_rank))::INTEGER AS rank FROM scored QUALIFY rank <= 10",
    }
    spell = lambda names, select, **kw: with_(names, select, **(_SPELL | kw))
    return {
        "tokenize_counts": with_("w", "SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_terms FROM w"),
        "clean_text": f"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS clean FROM documents",
        "title_body_concat": """SELECT doc_id, CASE WHEN coalesce(title, '') <> '' THEN trim(title || ' ' || coalesce(text, ''), ' ')
            ELSE trim(coalesce(text, ''), ' ') END AS full_text FROM documents""",
        "last_token": with_(
            "q",
            r"""SELECT qid, CASE WHEN length(l) >= 2 THEN lower(l) END AS last, list_aggregate(list_concat(w[1:len(w) - 1], ['X']), 'string_agg', ' ') AS fixed
            FROM (SELECT qid, regexp_split_to_array(query, '[\t\n\x{0B}\f\r ]+') AS w, regexp_split_to_array(query, '[\t\n\x{0B}\f\r ]+')[-1] AS l FROM q WHERE query IS NOT NULL)""",
        ),
        "shard_assignment": with_("p", "SELECT doc_id, (('0x' || substr(md5(doc_id), 1, 8))::BIGINT % 4)::INTEGER AS shard FROM p"),
        "doc_lengths": with_("w", "SELECT doc_id, len(w)::INTEGER AS dl FROM w"),
        "corpus_stats": with_("stats", "SELECT n, round(coalesce(avgdl, 0.0), 6) AS avgdl FROM stats"),
        "term_stats": with_("terms", "SELECT term, df, cf FROM terms"),
        "term_bounds": with_("idfs", f"SELECT term, max_tf, min_dl::INTEGER AS min_dl, round({impact(tf='max_tf', dl='min_dl')}, 6) AS bound FROM idfs"),
        "vocab_frequency": with_("vocab", "SELECT term, weight FROM vocab"),
        "idf_table": with_("idfs", "SELECT term, df, round(idf, 6) AS idf FROM idfs"),
        "impacts": with_("post idfs", f"SELECT term, doc_id, round({impact()}, 6) AS impact FROM post JOIN idfs USING (term)"),
        "bm25_single": single,
        "bm25_relational_top10": with_("ranked", top10),
        "bm25_batch_top10": with_("ranked", top10),
        "bm25_classic_params": with_("ranked", top10, 1.2, 0.75),
        "bm25_wand_top10": with_("ranked", top10),
        "sharded_bm25": with_("qt post", "SELECT qid, doc_id, shard, score, rank FROM sr", **_sharded()),
        "sharded_index_bm25": with_("qt post", "SELECT qid, doc_id, shard, score, rank FROM sr", **_sharded()),
        "sharded_wand_top10": with_("qt post", "SELECT qid, doc_id, shard, score, rank FROM sr", **_sharded()),
        "index_roundtrip": with_(
            "post",
            "SELECT shard, doc_id, term, tf, dl::INTEGER AS dl, df, cf FROM post JOIN st USING (shard, term)",
            st="SELECT shard, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY ALL",
        ),
        "shard_vs_single_overlap": with_(
            "ranked",
            """SELECT r.qid, round(avg((s.doc_id IS NOT NULL)::INTEGER), 6) AS overlap FROM ranked r
               LEFT JOIN sr s ON s.qid = r.qid AND s.doc_id = r.doc_id WHERE r.rank <= 10 GROUP BY r.qid""",
            **_sharded(),
        ),
        "shard_stats": with_("w", "SELECT shard, count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM w GROUP BY shard"),
        "posting_gaps": with_("gapped", f"SELECT shard, term, doc_id, gap, {varint('gap')} AS gap_bytes FROM gapped"),
        "posting_gaps_undone": with_("valid", "SELECT shard, term, doc_id::BIGINT AS doc_id FROM valid"),
        "index_stats": with_(
            "gapped",
            """SELECT shard, sum(docs)::BIGINT AS docs, sum(terms)::BIGINT AS terms, sum(postings)::BIGINT AS postings,
                      8 * sum(postings)::BIGINT AS raw, sum(bytes)::BIGINT AS compressed,
                      round(sum(postings) * 8.0 / nullif(sum(bytes), 0), 4) AS ratio,
                      round(100 - sum(bytes) * 12.5 / nullif(sum(postings), 0), 4) AS percent, round(sum(bytes) / 1048576.0, 4) AS mib
               FROM per GROUP BY ROLLUP (shard)""",
            per=f"""SELECT shard, count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, count(*) AS postings,
                    sum({varint("gap")} + {varint("tf")}) AS bytes FROM gapped GROUP BY shard""",
        ),
        "autocomplete": with_("vocab", "SELECT term, weight FROM vocab WHERE starts_with(term, 'pro') ORDER BY weight DESC, term LIMIT 8"),
        "autocomplete_batch": with_(
            "vocab words",
            """SELECT prefix, term, weight, (row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, term))::INTEGER AS rank
               FROM pre JOIN vocab ON substr(term, 1, length(prefix)) = prefix QUALIFY rank <= 8""",
            pre="SELECT DISTINCT substr(word, 1, 3) AS prefix FROM words WHERE length(word) >= 2",
        ),
        "delete_variants": with_("vocab", "SELECT term, variant FROM vocab_d2", **_deletes("vocab", "term", 2)),
        "spell_candidates": spell("words vocab", "SELECT word, term FROM cand"),
        "spell_topk": spell("words vocab", "SELECT word, term, distance, weight, rank FROM near WHERE rank <= 5"),
        "spell_correct": spell("words vocab", "SELECT word, term, distance, weight FROM near WHERE rank = 1"),
        "query_autocorrect": with_(
            "q vocab",
            """SELECT qid, CASE WHEN count(term) > 0 THEN string_agg(coalesce(term, w), ' ' ORDER BY i) END AS corrected
               FROM q LEFT JOIN each USING (qid) LEFT JOIN fix ON word = lower(w) GROUP BY qid""",
            each=r"""SELECT qid, w[i] AS w, i FROM (SELECT qid, w, unnest(range(1, len(w) + 1)) AS i FROM (
                     SELECT qid, list_filter(regexp_split_to_array(query, '[\t\n\x{0B}\f\r ]+'), lambda x: x <> '') AS w FROM q))""",
            words="SELECT DISTINCT lower(w) AS word FROM each",
            **_SPELL,
            fix="SELECT word, term FROM near WHERE rank = 1 AND distance > 0",
        ),
        "spell_accuracy": with_(
            "vocab",
            """SELECT count(*) AS pairs, sum((coalesce(near.term, '') = expected)::INTEGER)::BIGINT AS correct,
                      round(avg((coalesce(near.term, '') = expected)::INTEGER) * 100, 4) AS percent
               FROM typos LEFT JOIN near ON near.word = typo AND near.rank = 1""",
            typos="SELECT substr(term, 1, 2) || substr(term, 4) AS typo, term AS expected FROM vocab WHERE length(term) >= 3",
            words="SELECT DISTINCT typo AS word FROM typos",
            **_SPELL,
        ),
        "dense_knn": """
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
            s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 4) AS score
                  FROM v a, v b WHERE a.vec_id % 100 = 0)
            SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s QUALIFY rank <= 10""",
        "ann_recall": "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0",
        "cosine_normalize": """SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings""",
        "rrf_fuse": with_(
            "",
            "SELECT qid AS search_id, doc_id, score, rank FROM every WHERE rank <= 10",
            d="SELECT DISTINCT search_id AS qid, doc_id, bm25_rank, dense_rank FROM search_results",
            runs="""SELECT qid, doc_id, bm25_rank AS rank, 0 AS run FROM d WHERE bm25_rank IS NOT NULL
                    UNION ALL SELECT qid, doc_id, dense_rank, 1 FROM d WHERE dense_rank IS NOT NULL""",
            summed=_RRF,
            every=_FUSED,
        ),
        "hybrid_top10": with_("ranked logged", "SELECT qid, doc_id, score, rank FROM every WHERE rank <= 10", **_TWO),
        "rerank_head_tail": with_(
            "q p ranked logged",
            """SELECT qid, doc_id, round(CASE WHEN open THEN was WHEN ce IS NOT NULL THEN ce
                 ELSE coalesce(least, 0.0) - 1 - (rank - heads - 1) END, 6) AS score, rank
               FROM opened JOIN (SELECT qid, doc_id, score AS was FROM cut) USING (qid, doc_id) WHERE rank <= 20""",
            **reranked,
        ),
        "rerank_batched": with_(
            "q p ranked logged",
            """SELECT qid, doc_id, round(CASE WHEN open THEN was WHEN ce IS NOT NULL THEN ce
                 ELSE coalesce(least, 0.0) - 1 - (rank - heads - 1) END, 6) AS score, rank
               FROM opened JOIN (SELECT qid, doc_id, score AS was FROM cut) USING (qid, doc_id) WHERE rank <= 20""",
            **reranked,
        ),
        "funnel_provenance": with_(
            "q p ranked logged",
            """SELECT f.qid, f.doc_id, f.rank, b.score AS bm25_score, b.rank AS bm25_rank, l.score AS dense_score, l.rank AS dense_rank,
                      rrf_score, rrf_rank, ce_score, CASE WHEN ce_score IS NOT NULL THEN 'reranked' ELSE 'hybrid' END AS stage
               FROM final f LEFT JOIN ranked b ON b.rank <= 200 AND b.qid = f.qid AND b.doc_id = f.doc_id
               LEFT JOIN logged l ON l.qid = f.qid AND l.doc_id = f.doc_id""",
            **funnel,
        ),
        **{
            key: _graded(_MEASURES[m], m)
            for key, m in {"ndcg10": "nDCG@10", "rr10": "RR@10", "recall100": "R@100", "recall1000": "R@1000", "average_precision": "AP"}.items()
        },
        "scorecard": with_(
            "ranked judged",
            " UNION ALL ".join(
                f"SELECT '{m}' AS measure, round(avg(coalesce({v}, 0.0)), 4) AS value FROM ideal LEFT JOIN got USING (qid)" for m, v in _MEASURES.items()
            ),
            **_GRADED,
        ),
        "score_ranges": f"SELECT search_id, {ranges} FROM (SELECT DISTINCT * FROM search_results) GROUP BY search_id",
        "score_bars": f"""WITH d AS (SELECT DISTINCT * FROM search_results), r AS (SELECT search_id, {ranges} FROM d GROUP BY search_id)
            SELECT search_id, doc_id, {bars} FROM d JOIN r USING (search_id)""",
        "candidate_subset": with_("p logged", "SELECT doc_id, text FROM p WHERE doc_id IN (SELECT doc_id FROM logged WHERE rank <= 5)"),
        "tsv_roundtrip": with_("p", f"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text FROM p"),
        "run_roundtrip": with_("logged", "SELECT qid, doc_id, rank, round(score, 6) AS score, 'logged' AS tag FROM logged WHERE rank <= 10"),
        "posting_lists_roundtrip": with_("valid", "SELECT shard, term, doc_id::BIGINT AS doc_id, tf FROM valid"),
        "posting_list_bytes": with_(
            "gapped", f"SELECT shard, term, count(*) AS postings, sum({varint('gap')} + {varint('tf')})::BIGINT AS bytes FROM gapped GROUP BY ALL"
        ),
        "index_lookup": with_("post terms", "SELECT term, doc_id, tf, df FROM post JOIN terms USING (term) WHERE term IN ('protein', 'market')"),
        "vocabulary_with_terms": with_(
            "vocab words",
            """SELECT term, sum(weight)::BIGINT AS weight FROM (SELECT * FROM vocab UNION ALL SELECT word, 5 FROM words) GROUP BY term""",
        ),
        "embeddings_roundtrip": with_("q", "SELECT qid, 64 AS dim FROM q"),
        "engine_search": with_(
            "post idfs",
            "SELECT doc_id, score, rank, coalesce(text, '') AS text FROM top JOIN p USING (doc_id)",
            **one,
        ),
        "engine_answer": with_(
            "post idfs",
            """SELECT doc_id, (row_number() OVER (ORDER BY ce DESC, bm25_rank))::INTEGER AS rank, bm25_score, bm25_rank, ce AS ce_score, 'reranked' AS stage
               FROM (SELECT doc_id, score AS bm25_score, rank AS bm25_rank,
                       round(len(list_intersect(['how', 'does', 'the', 'protein', 'change', 'market'], list_distinct(w))) / 6.0, 6) AS ce
                     FROM top JOIN w USING (doc_id) WHERE rank <= 50) QUALIFY rank <= 10""",
            **(one | {"top": one["top"].replace("<= 10", "<= 200")}),
        ),
        "trec_run_lines": with_(
            "logged",
            "SELECT qid, rank, qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', score) || ' logged' AS line FROM logged WHERE rank <= 10",
        ),
    }
