"""SQL the queries are held against, for DuckDB over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["p3_found"] = r"""
WITH valid AS (
  SELECT unit_id, path, start_byte, end_byte FROM units
  QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY scanned_at DESC NULLS LAST, ingested_at DESC NULLS LAST, start_byte DESC NULLS LAST, end_byte DESC NULLS LAST) = 1
), files AS (
  SELECT path, max(octet_length(encode(content))) AS n FROM source_files WHERE content IS NOT NULL GROUP BY path
), sized AS (
  SELECT v.*, f.n, CASE
    WHEN regexp_matches(lower(v.path), '\.(py|pyi)$') THEN 'python'
    WHEN regexp_matches(lower(v.path), '\.(js|jsx|mjs|cjs)$') THEN 'javascript'
    WHEN regexp_matches(lower(v.path), '\.(ts|tsx|mts|cts)$') THEN 'typescript'
    WHEN regexp_matches(lower(v.path), '\.rs$') THEN 'rust'
    WHEN regexp_matches(lower(v.path), '\.(pl|pm|t)$') THEN 'perl' END AS language
  FROM valid v JOIN files f USING (path)
)
SELECT unit_id FROM sized JOIN size_limits l USING (language)
WHERE start_byte >= 0 AND start_byte < end_byte AND end_byte <= n AND end_byte - start_byte > l.max_bytes
"""

SQL["p7_found"] = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT case_id FROM calibration_cases),
raw AS (
  SELECT case_id, 'g' AS kind, json_extract_string(provenance, '$.source_group') AS k FROM calibration_cases
  UNION ALL SELECT case_id, 'a', json_extract_string(provenance, '$.author') FROM calibration_cases
  UNION ALL SELECT case_id, 's', scenario_id FROM adjudications WHERE case_id IN (SELECT case_id FROM ids)
), keys AS (
  SELECT DISTINCT case_id, kind || ':' || lower(trim(k)) AS k FROM raw
  WHERE k IS NOT NULL AND lower(trim(k)) NOT IN ('', '-', 'none', 'n/a', 'unknown')
), edges AS (
  SELECT DISTINCT a.case_id AS x, b.case_id AS y FROM keys a JOIN keys b USING (k) WHERE a.case_id <> b.case_id
), reach AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT x AS case_id, least(x, min(y)) AS group_case_id FROM reach GROUP BY x
"""

_LINED = r"""
WITH raw AS (
  SELECT DISTINCT case_id, lower(regexp_replace(split, '[\s\-_]', '', 'g')) AS split, map_values(evidence.source_documents) AS docs, json_extract_string(question_wire, '$.instructions') AS q,
    coalesce(CASE WHEN lower(trim(json_extract_string(provenance, '$.source_group'))) NOT IN ('', '-', 'none', 'n/a', 'unknown') THEN lower(trim(json_extract_string(provenance, '$.source_group'))) END, '(none)') AS source
  FROM calibration_cases
), lined AS (
  SELECT case_id, split, source, CASE WHEN split = 'development' THEN 'dev' WHEN split IN ('heldout', 'validation') THEN 'eval' END AS side,
    list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(docs, lambda t: string_split(t, chr(10)))), lambda l: regexp_replace(l, '\s', '', 'g')), lambda l: l <> ''))) AS lines,
    list_sort(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+'))) AS words FROM raw
), able AS (
  SELECT * FROM lined WHERE side IS NOT NULL AND len(lines) > 0 AND len(words) > 0
), reps AS (
  SELECT side, lines, words, min(case_id) AS class_id, max(case_id) AS last_id FROM able GROUP BY ALL
), pairs AS (
  SELECT d.class_id AS x, e.class_id AS y, d.last_id AS x_last, len(list_intersect(d.lines, e.lines)) AS l, len(d.lines) + len(e.lines) AS nl, len(list_intersect(d.words, e.words)) AS w, len(d.words) + len(e.words) AS nw
  FROM reps d JOIN reps e ON d.side = 'dev' AND e.side = 'eval'
), linked AS (
  SELECT * FROM pairs WHERE l > 0.5 * (nl - l) AND w > 0.75 * (nw - w)
)"""

SQL["p1_found"] = _LINED + """, classed AS (
  SELECT DISTINCT a.case_id, r.class_id, r.side FROM able a JOIN reps r USING (side, lines, words)
)
SELECT DISTINCT least(d.case_id, e.case_id) AS case_id_a, greatest(d.case_id, e.case_id) AS case_id_b
FROM linked JOIN classed d ON d.class_id = x AND d.side = 'dev' JOIN classed e ON e.class_id = y AND e.side = 'eval' WHERE d.case_id <> e.case_id
"""

SQL["p1_classes"] = _LINED + """, counts AS (
  SELECT 'dev' AS side, x AS class_id, count(*) AS n FROM linked GROUP BY x UNION ALL SELECT 'eval', y, count(*) FROM linked GROUP BY y
)
SELECT DISTINCT a.case_id, a.side, r.class_id, coalesce(c.n, 0)::BIGINT AS n_links FROM able a JOIN reps r USING (side, lines, words) LEFT JOIN counts c ON c.side = r.side AND c.class_id = r.class_id
"""

SQL["p1_report"] = _LINED + """, twins AS (
  SELECT DISTINCT y, x, x_last FROM linked
), hit AS (
  SELECT DISTINCT a.case_id, a.split, a.source FROM able a JOIN reps r USING (side, lines, words) JOIN twins t ON t.y = r.class_id WHERE a.side = 'eval' AND (t.x <> a.case_id OR t.x_last <> a.case_id)
)
SELECT a.split, a.source, count(DISTINCT a.case_id)::BIGINT AS n_cases, count(DISTINCT h.case_id)::BIGINT AS n_overlapping
FROM able a LEFT JOIN hit h ON h.case_id = a.case_id AND h.split = a.split AND h.source = a.source WHERE a.side = 'eval' GROUP BY a.split, a.source
"""

SQL["p3_check"] = SQL["p3_found"].replace("SELECT unit_id FROM sized", "SELECT unit_id, start_byte, end_byte, true AS within, true AS joined FROM sized")

SQL["p4_check"] = """
WITH valid AS (
  SELECT * FROM budget_estimates QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY estimated_at DESC, ingested_at DESC, body_bytes DESC, questions DESC, context_tokens DESC, total_tokens DESC) = 1
)
SELECT request_id, body_bytes, coalesce(questions, 0)::BIGINT AS questions,
  greatest(1, ceil(body_bytes / max_body_bytes), ceil(coalesce(questions, 0) / max_questions), ceil(coalesce(context_tokens, 0) / max_context_tokens))::BIGINT AS n_parts, true AS fits
FROM valid JOIN pack_limits USING (model) WHERE body_bytes > 0
"""

_GROUPED = SQL["p7_found"].replace("SELECT x AS case_id, least(x, min(y)) AS group_case_id FROM reach GROUP BY x", ", grouped AS (SELECT x AS case_id, least(x, min(y)) AS group_case_id FROM reach GROUP BY x)")

SQL["p7_tree_sizes"] = _GROUPED + """
, tied AS (
  SELECT group_case_id, case_id, k FROM grouped JOIN keys USING (case_id) WHERE k IN (SELECT k FROM keys GROUP BY k HAVING count(DISTINCT case_id) > 1)
)
SELECT group_case_id, count(DISTINCT case_id)::BIGINT AS n_cases, count(DISTINCT k)::BIGINT AS n_keys, (count(DISTINCT case_id) + count(DISTINCT k) - 1)::BIGINT AS n_edges FROM tied GROUP BY group_case_id
"""

SQL["p7_together"] = _GROUPED + """
SELECT group_case_id, count(*)::BIGINT AS n_cases, 1::BIGINT AS n_splits FROM grouped GROUP BY group_case_id
"""

SQL["p9_check"] = "SELECT DISTINCT nullif(lower(trim(source)), '') AS source, true AS kept FROM mix_targets WHERE nullif(lower(trim(source)), '') IS NOT NULL"

SQL["p8_exact"] = "SELECT count(*)::BIGINT AS n_docs, count(*)::BIGINT AS n_exact FROM documents"
