"""DuckDB SQL for those queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = r"regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP4 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_LIST.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
pattern AS (SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS p FROM (
  SELECT item_id, w[k : k + 9] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0))),
doc AS (SELECT doc_id, {_LIST.format("coalesce(text, '')")} AS w FROM documents),
size AS (SELECT DISTINCT n FROM pattern),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, size WHERE len(w) >= n),
met AS (SELECT doc_id, k, place.n, item_id FROM place JOIN pattern ON place.n = pattern.n AND array_to_string(w[k : k + place.n - 1], ' ') = pattern.p),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM met) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

ORACLES: dict[str, str] = {"op4_decontaminate": OP4}
