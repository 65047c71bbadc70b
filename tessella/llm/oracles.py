"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

OP1 = f"""
WITH items AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), wins AS (
    SELECT DISTINCT item, least(13, len(w)) AS k,
           array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), spans AS (
    SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM docs, (SELECT DISTINCT k FROM wins) ks WHERE len(w) >= k
), found AS (
    SELECT s.r, s.i, s.k, x.item
    FROM spans s JOIN wins x ON x.k = s.k AND x.win = array_to_string(list_slice(s.w, s.i, s.i + s.k - 1), ' ')
), hit AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r
), named AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP2 = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w
    FROM documents
), wins AS (
    SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), again AS (
    SELECT r, i FROM wins WHERE h IN (SELECT h FROM wins GROUP BY h HAVING count(*) > 1)
), gone AS (
    SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM again GROUP BY r
), kept AS (
    SELECT doc_id, len(w) AS n, coalesce(len(g), 0) AS m,
           CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(g, j)) END AS k
    FROM docs LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

OP4 = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
    SELECT r, vec_id, label, e FROM v
    WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.r AS a, b.r AS b FROM good a JOIN good b
    ON a.label = b.label AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (
    SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""

_TRIM = "trim(x, ' ' || chr(9) || chr(13))"

OP10 = f"""
WITH lines AS (
    SELECT source, {_TRIM} AS l FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents)
), bad AS (
    SELECT l FROM lines WHERE l <> '' GROUP BY l HAVING count(DISTINCT source) >= 10
), docs AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), cut AS (
    SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(b, {_TRIM})) AS kept
    FROM docs, (SELECT coalesce(list(l), []) AS b FROM bad) x
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM cut
"""


def _licenses() -> str:
    from .licenses import SHINGLE, TEMPLATES, shingles, template_words, window_of

    rows = []
    for name, text in sorted(TEMPLATES.items()):
        words = template_words(text)
        width, step = window_of(len(words))
        grams = sorted({g.decode() for g in shingles(words)})
        rows += [f"('{name}', '{g}', {width}, {step}, {len(grams)})" for g in grams]
    return f"""
WITH t(license, gram, width, step, size) AS (VALUES {", ".join(rows)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
grams AS (
    SELECT r, i - 1 AS p, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS gram
    FROM (SELECT r, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM docs WHERE len(w) >= {SHINGLE})
), seen AS (SELECT r, p, license, t.gram, width, step, size FROM grams JOIN t USING (gram)
), wins AS (
    SELECT r, license, gram, size,
           unnest(range(CAST(greatest(0, ceil((p - width + {SHINGLE}) / step)) AS BIGINT), p // step + 1)) AS k
    FROM seen
), found AS (
    SELECT DISTINCT r, license FROM (
        SELECT r, license, k FROM wins GROUP BY r, license, k, size HAVING count(DISTINCT gram) >= 0.8 * size)
), named AS (SELECT r, count(*) AS n, string_agg(license, ',' ORDER BY license) AS l FROM found GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(l, '') AS licenses
FROM docs LEFT JOIN named USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_substring_dedup": OP2, "op4_embedding_dedup": OP4,
        "op8_licenses": _licenses(),
        "op10_line_dedup": OP10}
