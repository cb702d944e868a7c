"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """Distinct five-word shingles, or the whole sequence of fewer words."""
    return f"""
        SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5
            THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, {_WORDS} AS w FROM (SELECT {key}, {_LOWER} AS t FROM {table}))"""


ORACLE: dict[str, str] = {
    "op8_minhash_containment": f"""
        WITH d AS ({_shingles("documents", "doc_id")}),
        b AS ({_shingles("benchmark", "item_id")}),
        sizes AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
        hits AS (SELECT doc_id, item_id FROM d JOIN b USING (s) JOIN sizes USING (item_id)
                 GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)),
        lists AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM hits GROUP BY doc_id)
        SELECT doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(item_ids, '') AS item_ids
        FROM documents LEFT JOIN lists USING (doc_id)""",
    "op13_pq_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i])) AS BIGINT) AS score
            FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
    "op12_prefix_trie": """
        WITH crc AS (SELECT list(v ORDER BY n) AS tbl FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
        t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                lambda s, b: xor(s >> 8, tbl[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM t), crc),
        s AS (SELECT c.conv_id, i, x FROM c JOIN t ON t.conv_id = base AND i < h
            UNION ALL SELECT c.conv_id, i + 10, x FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h),
        r AS (SELECT c.conv_id, coalesce(list(x ORDER BY i) FILTER (WHERE x IS NOT NULL), []) AS seq FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
        p AS (SELECT conv_id, d, seq[1:d] AS pre, d = len(seq) AS last FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
        n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE length(pre[d].t) END AS chars,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY pre, d),
        k AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.pre = n.pre),
        u AS (SELECT pre[1:e] AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
            FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY 1)
        SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN u ON u.pre = m.pre LEFT JOIN n up ON m.d > 0 AND up.d = m.d - 1 AND up.pre = m.pre[1:m.d - 1]""",
}
