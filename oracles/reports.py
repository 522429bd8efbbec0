"""Oracles of the report, text and star-schema queries."""

from __future__ import annotations

from .base import quote
from .pages import clean, clip, full, trim
from .retrieval import TABLES as BASE
from .retrieval import parse

DIRTY = "'  ' || chr(7) || replace(text, chr(10), chr(13) || chr(10)) || chr(27) || '[31m' || chr(9) || chr(160)"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+([/?#]\S*)?$"
REST = "regexp_replace(url, '^[a-z]+://', '')"

TABLES = BASE
TABLES.update({
    "dirty": f"SELECT doc_id, text, {full(DIRTY)} AS f, {full('text')} AS b, length({clean(DIRTY, True)}) AS code_chars FROM documents",
    "shapes": """
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS shape, t AS text FROM (SELECT p_partkey, unnest(range(1, 9)) AS i, unnest([p_name, replace(p_name, ' ', '_'), '  ' || p_brand || '.', replace(p_brand, '#', '_') || '.' || upper(p_name),
  '"a""' || p_name || '".x', p_type || '.b.c', chr(220) || p_type, p_type || chr(10)]) AS t FROM part) x""",
    "urls": f"""
SELECT page_id, url, html, CASE page_id % 5 WHEN 0 THEN 'postgres://user:p%40ss-w0rd!' || page_id || '@' || {REST}
  WHEN 1 THEN 'postgres://' || split_part(split_part({REST}, '#', 1), '?', 1) || '?password=hunter' || page_id || '&sslmode=require&sslKey=a%2Fb'
  WHEN 2 THEN 'not a url ' || url ELSE url END AS secret_url FROM pages""",
    # What each of the five shapes must look like once redacted, stated shape by shape.
    "redacted": f"""
SELECT page_id, secret_url, html, CASE page_id % 5 WHEN 0 THEN 'postgres://user:***@' || {REST} WHEN 1 THEN 'postgres://' || split_part(split_part({REST}, '#', 1), '?', 1) || '?sslmode=require'
  WHEN 2 THEN '<database url>' ELSE secret_url END AS redacted FROM urls""",
    "scrubbed": """
SELECT page_id, 'failed for ' || redacted || '; ' || CASE page_id % 5 WHEN 0 THEN '*** / *** / hunter' || page_id || ' / a/b / a%2Fb '
  WHEN 1 THEN 'p%40ss-w0rd!' || page_id || ' / p@ss-w0rd!' || page_id || ' / *** / *** / *** ' ELSE 'p%40ss-w0rd!' || page_id || ' / p@ss-w0rd!' || page_id || ' / hunter' || page_id || ' / a/b / a%2Fb ' END AS start,
  CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN replace(replace(html, 'hunter' || page_id, '***'), 'a/b', '***') ELSE replace(html, secret_url, redacted) END AS rest FROM redacted""",
    "form_line": """
SELECT catalog_id, 'A' AS form, concat_ws('|', relation_id, ordinal, name, type, CAST(nullable AS VARCHAR), coalesce("default", ''), coalesce(identity, ''), coalesce(generated, ''), coalesce(comment, ''), coalesce(enum_id, '')) AS line FROM live_col
UNION ALL SELECT DISTINCT catalog_id, 'A', 'relation_id|ordinal|name|type|nullable|default|identity|generated|comment|enum_id' FROM live_col
UNION ALL SELECT catalog_id, 'B', concat_ws('|', relation_id, kind, columns, warnings, purpose) FROM overviewed
UNION ALL SELECT catalog_id, 'C', line FROM all_lines
UNION ALL SELECT catalog_id, 'D', line FROM ddl""",
    "form_size": "SELECT catalog_id, form, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM form_line GROUP BY catalog_id, form",
})

SQL = {
    "ordered_children": """
SELECT o_orderkey, o_custkey, position, item FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS item,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_extendedprice) AS position FROM lineitem) l ON l_orderkey = o_orderkey""",
    "scoped_orders": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))",
    "clean_documents": f"""
SELECT doc_id, {clip('f', 500)} AS field, coalesce(length(f) > 500, false) AS field_cut, {clip('b', 120)} AS brief, coalesce(length(b) > 120, false) AS brief_cut, sha256(f) AS full_hash, CAST(length(f) AS INTEGER) AS full_chars, CAST(code_chars AS INTEGER) AS code_chars,
  CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS tokens FROM dirty""",
    "truncated_documents": f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position, pointer FROM (
  SELECT doc_id, 1 AS i, '/documents/' || doc_id || '/text' AS pointer FROM documents WHERE length({full('text')}) > 500
  UNION ALL SELECT doc_id, 2, '/documents/' || doc_id || '/a~1b~0c' FROM documents WHERE length({full('text')}) > 8000
  UNION ALL SELECT doc_id, 3, '/documents/' || doc_id || '/' || source FROM documents WHERE length({full('source')}) > 4) x""",
    "identifiers": f"SELECT p_partkey, shape, text, {quote('text')} AS quoted, array_to_string({parse('text')}, '|') AS parts FROM shapes",
    "search_documents": """
SELECT doc_id, contains(lower(text), 'the and') AS words, contains(text, '%') AS percent, contains(text, '.*') AS stars FROM documents
WHERE contains(lower(text), 'the and') OR contains(text, '%') OR contains(text, '.*')""",
    "label_overrides": """
SELECT d.doc_id, d.n_chars > 2000 AS automatic, l.quality = 1 AS "override", coalesce(l.quality = 1, d.n_chars > 2000) AS effective FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "redact_urls": "SELECT page_id, redacted FROM redacted",
    "scrub_messages": "SELECT page_id, sha256(start || rest) AS scrubbed_hash, CAST(length(start) + length(rest) AS INTEGER) AS n_chars FROM scrubbed",
    "latency_summary": """
SELECT event_type, count(*) AS n, min(value) AS minimum, list_sort(list(value))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1] AS median,
  list_sort(list(value))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type""",
    "size_breakdown": """
SELECT *, total - front - structure - prose AS other, CAST(floor(total / 4 + 0.5) AS BIGINT) AS tokens FROM (
  SELECT catalog_id, CAST(sum(length(text)) AS BIGINT) AS total, CAST(sum(coalesce(length(front), 0)) AS BIGINT) AS front, CAST(sum(coalesce(length(block), 0)) AS BIGINT) AS structure,
    CAST(sum(coalesce(length(before), 0) + coalesce(length(after), 0)) AS BIGINT) AS prose FROM blocks GROUP BY catalog_id) x""",
    "document_sizes": f"""
SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(length({trim(clean('text'))})) AS BIGINT) AS clean_chars, round(sum(length({trim(clean('text'))})) / sum(n_chars), 2) AS ratio
FROM documents GROUP BY lang, source""",
    "size_report": """
SELECT f.catalog_id, f.form, f.chars, CAST(floor(f.chars / 4 + 0.5) AS BIGINT) AS tokens, round(f.chars / d.chars, 2) AS ratio
FROM form_size f LEFT JOIN form_size d ON d.catalog_id = f.catalog_id AND d.form = 'D'""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
}
