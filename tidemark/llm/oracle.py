"""The same results as DuckDB's SQL, for queries whose results SQL can give."""

from __future__ import annotations

#: Fixed values of the contracts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches between which the split text lies, so that lengths give places."""
    p = _quoted(pattern)
    return f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS b FROM d"


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_kind('assign', 1, ASSIGN, 2, 6)} UNION ALL {_kind('access', 2, 'AKIA[A-Z0-9]{16,}', 0, 20)} UNION ALL {_kind('hex', 3, '[0-9a-f]{24,}', 0, 24)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
s AS (SELECT doc_id, kind, rank, length(v[i]) >= least AS ok, coalesce(list_sum([length(x) FOR x IN b[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS a, length(m[i]) AS n FROM i),
j AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR), ',' ORDER BY a, rank) AS spans FROM s WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON j.doc_id = d.doc_id"""

NEAR_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.id AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, min(c) = r.id AS kept FROM r LEFT JOIN n ON n.a = r.id GROUP BY r.id"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_quoted(WORD)}) AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""

NGRAMS = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(WORD)}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id"""

#: A text's bytes are cut into overlapping parts first, so that no window is cut from a long string.
SUFFIXES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, z, substr(h, CAST(z * 512 + 1 AS BIGINT), 512 + 198) AS h FROM (SELECT *, unnest(range(0, CAST(ceil(length(h) / 512.0) AS BIGINT))) AS z FROM d)),
p AS (SELECT doc_id, z * 256 + i AS i, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) END AS k
 FROM (SELECT *, unnest(range(0, least(256, length(h) // 2))) AS i FROM q)),
f AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS head FROM c),
o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE head) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""

ORACLE = {"op1_secret_scan": SECRETS, "op3_embedding_dedup": NEAR_VECTORS, "op4_substring_dedup": SUBSTRINGS, "op8_ngram_join": NGRAMS, "op10_suffix_dedup": SUFFIXES}
