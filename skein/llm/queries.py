"""The queries of this subpackage and, where SQL can express them, their oracles for DuckDB."""

from __future__ import annotations

from skein.llm.bpe import op7_byte_bpe
from skein.llm.embed_dedup import op2_embedding_dedup
from skein.llm.langid import language_id_of_pages, op1_language_id
from skein.llm.line_dedup import op6_line_dedup
from skein.llm.packing import op4_packing
from skein.llm.simhash import op5_simhash
from skein.llm.tokenbin import op3_token_order
from skein.llm.topk import op8_exact_top_k
from skein.llm.toxicity import op9_toxicity
from skein.llm.url_filter import op10_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_order": op3_token_order,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "language_id_of_pages": language_id_of_pages,  # the first operator again, where all its evidence acts
}

ORACLES = {
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op10_url_filter": r"""
        WITH RECURSIVE u AS (
            SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages
        ), rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        j AS (
            SELECT page_id, html, host, path, arg_max(action, length(h || p)) AS action, arg_max(h || p, length(h || p)) AS rule
            FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id, html, host, path
        ), hosts AS (
            SELECT host, count(*) AS n, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'allow') AS allowed FROM j WHERE host <> '' GROUP BY host
        ), w AS (
            SELECT host, CASE WHEN blocked / n >= 0.5 THEN 'distrust' WHEN allowed > blocked THEN 'trust' END AS kind, CASE WHEN blocked / n >= 0.5 THEN blocked / n ELSE 1 - blocked / n END AS weight FROM hosts
        ), seeds AS (SELECT host, kind, weight / sum(weight) OVER (PARTITION BY kind) AS start FROM w WHERE kind IS NOT NULL),
        l AS (
            SELECT host AS src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
                SELECT host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i:href|src)\s*=\s*["'']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''<>\s]+)', 1))) AS named, translate(named, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM j WHERE host <> '')
            WHERE host <> dst GROUP BY 1, 2
        ), e AS (
            SELECT src, dst, kind, weight / sum(weight) OVER (PARTITION BY src, kind) AS share
            FROM (SELECT src, dst, 'trust' AS kind, weight FROM l UNION ALL SELECT dst, src, 'distrust', weight FROM l)
        ), has_out AS (SELECT DISTINCT src, kind FROM e),
        it(k, host, kind, mass) AS (
            SELECT 0, host, kind, start FROM seeds
            UNION ALL
            SELECT k + 1, host, kind, sum(part) FROM (
                SELECT it.k, e.dst AS host, it.kind, 0.85 * mass * share AS part, it.host AS of FROM it JOIN e ON e.src = it.host AND e.kind = it.kind WHERE it.k < 100
                UNION ALL
                SELECT it.k, s.host, it.kind, mass * (CASE WHEN o.src IS NULL THEN 1 ELSE 0.15 END) * s.start, it.host
                FROM it JOIN seeds s ON s.kind = it.kind LEFT JOIN has_out o ON o.src = it.host AND o.kind = it.kind WHERE it.k < 100)
            GROUP BY k, host, kind
        ), m AS (
            SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM it WHERE k = 100 GROUP BY host
        )
        SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN m USING (host)
    """,
}
