"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

OP10 = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def _kind(name: str, pattern: str, flags: str, group: int, least: int) -> str:
    whole = f"regexp_extract_all(text, '{pattern}', 0{flags})"
    value = f"regexp_extract_all(text, '{pattern}', {group}{flags})"
    # DuckDB takes no flags in string_split_regex; (?i) stands in the pattern.
    split = f"string_split_regex(text, '{'(?i)' if flags else ''}{pattern}')"
    return f"""
    {name}_raw AS (
        SELECT doc_id, source, {whole} AS w, {value} AS v, {split} AS p FROM d
        WHERE regexp_matches(text, '{'(?i)' if flags else ''}{pattern}')
    ),
    {name}_all AS (
        SELECT doc_id, source, unnest(w) AS w, unnest(v) AS v, unnest(p[:len(w)]) AS p,
               unnest(range(1, len(w) + 1)) AS i FROM {name}_raw
    ),
    {name}_spans AS (
        SELECT doc_id, source, '{name}' AS kind, v, sum(length(p) + length(w)) OVER x AS e, length(w) AS n
        FROM {name}_all WINDOW x AS (PARTITION BY doc_id ORDER BY i)
    )"""


_ASSIGN = r'(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)'

OP3 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    {_kind("assign", _ASSIGN, ", 'i'", 2, 12)},
    {_kind("access", "AKIA[A-Z0-9]+", "", 0, 18)},
    {_kind("hex", "[0-9a-f]+", "", 0, 16)},
    base AS (
        SELECT doc_id, source, kind, v, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, r FROM (
            SELECT *, 0 AS r FROM assign_spans WHERE length(v) >= 12
            UNION ALL SELECT *, 1 AS r FROM access_spans WHERE length(v) >= 18
            UNION ALL SELECT *, 2 AS r FROM hex_spans WHERE length(v) >= 16
        )
    ),
    looks AS (
        SELECT v, count(DISTINCT coalesce(source, '')) <= 1 AS live, count(DISTINCT doc_id) AS repositories
        FROM base WHERE len(list_distinct(string_split(v, ''))) >= 6 GROUP BY v
    ),
    marked AS (SELECT base.*, looks.live, looks.repositories FROM base LEFT JOIN looks USING (v)),
    every AS (
        SELECT doc_id, s, r, kind || ':' || s || ':' || e AS said FROM base
        UNION
        SELECT doc_id, e - length(v) AS s, 3 AS r, 'live:' || (e - length(v)) || ':' || e AS said FROM marked WHERE live
    ),
    counted AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS said,
               count(*) FILTER (NOT live) AS n_copied, max(repositories) FILTER (live) AS spread
        FROM marked GROUP BY doc_id
    ),
    listed AS (
        SELECT doc_id, string_agg(said, ',' ORDER BY s, r, said) AS spans, count(*) FILTER (r = 3) AS n_live
        FROM every GROUP BY doc_id
    )
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(spread, 0) AS n_repositories
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
    ),
    repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS said
        FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(said, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    strings AS (
        SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)
    ),
    repeated AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM strings) WHERE least < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM repeated),
    spans AS (
        SELECT doc_id, count(*) AS n, count(*) FILTER (p <> before + 1 OR before IS NULL) AS spans
        FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id
    ),
    bytes AS (
        SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)
    ),
    kept AS (
        SELECT doc_id, string_agg(byte, '' ORDER BY p) AS said FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(said, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11 = """
WITH e AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
        FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

ORACLES = {
    "op3_secret_scan": OP3,
    "op6_substring_dedup": OP6,
    "op9_suffix_dedup": OP9,
    "op10_exact_dedup": OP10,
    "op11_top_k_search": OP11,
}
