"""Raw catalog extracts derived from star-schema tables.

A real run reads extracts of database catalogs (see ``raw.py``). To exercise
every operator on data that grows, the star schema itself is read as metadata
of one database per nation: each order, customer, part and supplier is a
relation, each (order, line number) a column, keys between them are foreign
keys, documents are note pages. Snapshot ``s2`` is ``s1`` after a fixed set of
changes (relations dropped and added, types, comments, validity changed).

The statements use only syntax that Spark and an ANSI engine share; ``ARR(``,
``EXPLODE(`` and ``NO_INTS`` stand for the array constructor, the row generator
and the typed null array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small
from .store import LazyTables, Tables, land

# Column-name stems, chosen by part key: sensitive names, look-alikes, names to quote.
STEMS = [
    "customer_email", "tokens_used_count", "tc_kimlik", "card_number", "Mixed Case", "emailed_at",
    "shipping_address", "api_secondary_key", "last_ip_address", "dotted.col", "quantity", "note",
]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _name(*tail: str) -> str:
    """Stored name of an order's relation, or of an object named after it."""
    end = "".join(f", {part}" for part in tail)
    return (
        f"CASE WHEN pri = '1-URGENT' THEN concat('Order ', k{end}) "
        f"""WHEN pri = '2-HIGH' THEN concat('odd."', k, '"'{end}) ELSE concat('order_', k{end}) END"""
    )


def _quoted(*tail: str) -> str:
    """The same name as the server prints it."""
    end = "".join(f", {part}" for part in tail)
    return (
        f"""CASE WHEN pri = '1-URGENT' THEN concat('"Order ', k{end}, '"') """
        f"""WHEN pri = '2-HIGH' THEN concat('"odd.""', k, '""'{end}, '"') ELSE concat('order_', k{end}) END"""
    )


_ID = f"concat(schema_name, '.', {_quoted()})"
_HEAD = "catalog_id, snapshot_id"

STATEMENTS: dict[str, str] = {
    # One row per order and snapshot.
    "order_base": """
SELECT concat('db', lpad(cast(n AS string), 2, '0')) AS catalog_id, concat('s', ver) AS snapshot_id, ver, k, c, n,
       CASE st WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS schema_name,
       CAST(CASE st WHEN 'F' THEN 4 WHEN 'O' THEN 5 ELSE 6 END AS bigint) AS nsp, pri, price,
       CASE WHEN c % 10 = 0 THEN 'ext' ELSE 'sales' END AS customer_schema
FROM (SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS n, o_orderstatus AS st, o_orderpriority AS pri,
             o_totalprice AS price, EXPLODE(ARR(1, 2)) AS ver
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey) x
WHERE NOT (ver = 2 AND k % 17 = 0) AND NOT (ver = 1 AND k % 37 = 0)""",
    # One row per (order, line number) and snapshot: a column of the order's relation.
    "line_base": f"""
SELECT b.*, ln, p, s, rf, ls, qty, s_nationkey AS sn, (k + ln) % 29 = 0 AS dropped,
       concat({_case('p % 12', STEMS)}, '_', ln) AS attname,
       CASE WHEN p % 12 IN (4, 9) THEN concat('"', {_case('p % 12', STEMS)}, '_', ln, '"')
            ELSE concat({_case('p % 12', STEMS)}, '_', ln) END AS quoted_attname,
       CAST(CASE WHEN ver = 2 AND k % 19 = 0 THEN 2
                 ELSE CASE s % 8 WHEN 0 THEN 6 + nsp WHEN 1 THEN 13 WHEN 2 THEN 20 WHEN 3 THEN 22 WHEN 4 THEN 3
                                 WHEN 7 THEN 1 ELSE 2 END END AS bigint) AS typid
FROM (SELECT l_orderkey, l_linenumber AS ln, min(l_partkey) AS p, min(l_suppkey) AS s, max(l_returnflag) AS rf,
             max(l_linestatus) AS ls, CAST(sum(l_quantity) AS bigint) AS qty
      FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) g
JOIN {{order_base}} b ON b.k = g.l_orderkey
JOIN {{supplier}} ON s_suppkey = g.s""",
    # One row per customer, part, supplier and nation and snapshot.
    "entity_base": """
SELECT concat('db', lpad(cast(n AS string), 2, '0')) AS catalog_id, concat('s', ver) AS snapshot_id, ver, n, what, k, label
FROM (SELECT CAST(n AS int) AS n, what, CAST(k AS bigint) AS k, label, EXPLODE(ARR(1, 2)) AS ver
      FROM (SELECT c_nationkey AS n, 'customer' AS what, c_custkey AS k, c_mktsegment AS label FROM {customer}
            UNION ALL SELECT p_partkey % 25, 'part', p_partkey, p_name FROM {part}
            UNION ALL SELECT s_nationkey, 'supplier', s_suppkey, s_name FROM {supplier}
            UNION ALL SELECT n_nationkey, 'nation', n_nationkey, n_name FROM {nation}) e) x""",
    "namespaces": """
SELECT DISTINCT catalog_id, snapshot_id, CAST(oid AS bigint) AS oid,
       CASE oid WHEN 1 THEN 'ext' WHEN 2 THEN 'parts' WHEN 3 THEN 'sales' WHEN 4 THEN 'finished'
                WHEN 5 THEN 'open' ELSE 'pending' END AS nspname
FROM (SELECT catalog_id, snapshot_id, EXPLODE(ARR(1, 2, 3, 4, 5, 6)) AS oid
      FROM {entity_base} WHERE what = 'nation') x""",
    # Configured schemas in order; s2 reorders some lists and narrows others.
    "scopes": """
SELECT catalog_id, snapshot_id, schema_name AS schema,
       CAST(CASE WHEN ver = 2 AND n % 4 = 0 THEN 6 - i ELSE i END AS int) AS position
FROM (SELECT catalog_id, snapshot_id, ver, n, i,
             CASE i WHEN 1 THEN 'finished' WHEN 2 THEN 'open' WHEN 3 THEN 'pending' WHEN 4 THEN 'sales' ELSE 'parts' END AS schema_name
      FROM (SELECT catalog_id, snapshot_id, ver, n, EXPLODE(ARR(1, 2, 3, 4, 5)) AS i
            FROM {entity_base} WHERE what = 'nation') y) x
WHERE NOT (i = 1 AND n % 2 = 1) AND NOT (ver = 2 AND i = 3 AND n % 6 = 1)""",
    "relations": f"""
SELECT {_HEAD}, 10 + 4 * k AS oid, nsp AS relnamespace, {_name()} AS relname,
       CASE WHEN ver = 2 AND k % 31 = 0 THEN 'p' WHEN k % 10 = 0 THEN 'v' WHEN k % 10 = 1 THEN 'm'
            WHEN k % 10 = 2 THEN 'p' WHEN k % 10 = 9 THEN 'S' ELSE 'r' END AS relkind,
       CASE WHEN k % 7 = 0 THEN CAST(-1 AS double) WHEN k % 11 = 0 THEN CAST('NaN' AS double) ELSE price END AS reltuples,
       CASE WHEN ver = 2 AND k % 13 = 0 THEN concat('changed ', k) WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '   '
            WHEN k % 5 = 2 THEN concat(pri, ' order', chr(13), chr(10), 'bell', chr(7)) ELSE concat('Order ', k) END AS comment,
       concat(' SELECT id, customer_id FROM t', k, CASE WHEN ver = 2 AND k % 20 = 0 THEN ' WHERE true' ELSE '' END, chr(10), '  ') AS view_definition,
       'RANGE (id)' AS partition_key, k % 23 = 0 AS relispartition
FROM {{order_base}}
UNION ALL
SELECT {_HEAD}, CASE what WHEN 'nation' THEN 1 WHEN 'customer' THEN 11 + 4 * k WHEN 'part' THEN 12 + 4 * k ELSE 13 + 4 * k END,
       CAST(CASE WHEN what = 'nation' THEN 3 WHEN what <> 'customer' THEN 2 WHEN k % 10 = 0 THEN 1 ELSE 3 END AS bigint),
       CASE WHEN what = 'nation' THEN 'nation' ELSE concat(what, '_', k) END, 'r', CAST(k AS double),
       CASE WHEN k % 3 = 0 THEN NULL ELSE label END, ' ', ' ', false
FROM {{entity_base}}""",
    "attributes": f"""
SELECT {_HEAD}, 10 + 4 * k AS attrelid, CAST(2 + ln AS int) AS attnum,
       CASE WHEN dropped THEN concat('........pg.dropped.', 2 + ln, '........') ELSE attname END AS attname, typid AS atttypid,
       CASE typid WHEN 1 THEN 'integer' WHEN 2 THEN 'text' WHEN 3 THEN 'numeric(10,2)' WHEN 10 THEN 'finished.priority'
                  WHEN 11 THEN 'open.priority' WHEN 12 THEN 'pending.priority' WHEN 13 THEN 'ext.currency'
                  WHEN 20 THEN 'open.priority[]' ELSE 'point' END AS type_text,
       rf = 'N' AS attnotnull, CASE WHEN s % 8 = 7 AND ls = 'O' THEN 's' ELSE '' END AS attgenerated,
       CASE WHEN NOT (ls = 'O' OR s % 8 = 5) THEN NULL WHEN typid = 2 THEN '''x''::text' ELSE concat('(id + ', p, ')') END AS expr,
       '' AS attidentity,
       CASE WHEN p % 4 = 0 OR (ver = 2 AND k % 41 = 0) THEN NULL ELSE concat('qty ', qty) END AS comment, dropped AS attisdropped
FROM {{line_base}}
UNION ALL
SELECT {_HEAD}, 10 + 4 * k, i, CASE i WHEN 1 THEN 'id' WHEN 2 THEN 'customer_id' ELSE 'ctid' END, CAST(1 AS bigint),
       'integer', i <> 2 OR k % 2 = 0, '', NULL, CASE WHEN i = 1 AND k % 3 = 0 THEN 'a' WHEN i = 1 AND k % 3 = 1 THEN 'd' ELSE '' END,
       NULL, false
FROM (SELECT catalog_id, snapshot_id, k, EXPLODE(ARR(1, 2, -1)) AS i FROM {{order_base}}) o
UNION ALL
SELECT {_HEAD}, CASE what WHEN 'nation' THEN 1 WHEN 'customer' THEN 11 + 4 * k WHEN 'part' THEN 12 + 4 * k ELSE 13 + 4 * k END,
       i, CASE WHEN i = 1 THEN 'id' WHEN i = 3 THEN 'email' WHEN what = 'supplier' THEN 'region' ELSE 'nation_id' END,
       CAST(CASE WHEN i = 3 THEN 2 ELSE 1 END AS bigint), CASE WHEN i = 3 THEN 'text' ELSE 'integer' END, i = 1, '', NULL, '',
       CASE WHEN i = 3 THEN 'Current login email' ELSE NULL END, false
FROM (SELECT catalog_id, snapshot_id, what, k, EXPLODE(ARR(1, 2, 3)) AS i FROM {{entity_base}}) e
WHERE i = 1 OR (i = 2 AND what IN ('customer', 'supplier')) OR (i = 3 AND what = 'customer')""",
    "types": """
SELECT catalog_id, snapshot_id, CAST(oid AS bigint) AS oid,
       CAST(CASE oid WHEN 10 THEN 4 WHEN 11 THEN 5 WHEN 12 THEN 6 WHEN 13 THEN 1 WHEN 14 THEN 5 WHEN 20 THEN 5
                     WHEN 21 THEN 1 WHEN 22 THEN 5 ELSE 0 END AS bigint) AS typnamespace,
       CASE oid WHEN 1 THEN 'int4' WHEN 2 THEN 'text' WHEN 3 THEN 'numeric' WHEN 13 THEN 'currency' WHEN 14 THEN 'unused'
                WHEN 20 THEN '_priority' WHEN 21 THEN '_currency' WHEN 22 THEN 'point' ELSE 'priority' END AS typname,
       CASE WHEN oid BETWEEN 10 AND 14 THEN 'e' ELSE 'b' END AS typtype,
       CASE WHEN oid IN (20, 21) THEN 'A' WHEN oid = 22 THEN 'G' WHEN oid BETWEEN 10 AND 14 THEN 'E'
            WHEN oid = 2 THEN 'S' ELSE 'N' END AS typcategory,
       CAST(CASE oid WHEN 20 THEN 11 WHEN 21 THEN 13 WHEN 22 THEN 11 ELSE 0 END AS bigint) AS typelem
FROM (SELECT catalog_id, snapshot_id, EXPLODE(ARR(1, 2, 3, 10, 11, 12, 13, 14, 20, 21, 22)) AS oid
      FROM {entity_base} WHERE what = 'nation') x""",
    "enum_labels": """
SELECT DISTINCT catalog_id, snapshot_id, 6 + nsp AS enumtypid, CAST(substring(pri, 1, 1) AS double) AS enumsortorder, pri AS enumlabel
FROM {order_base} WHERE NOT (ver = 2 AND n % 5 = 0 AND pri = '5-LOW')
UNION ALL
SELECT DISTINCT catalog_id, snapshot_id, CAST(13 AS bigint), CAST(ascii(label) AS double), label FROM {entity_base} WHERE what = 'customer'
UNION ALL
SELECT catalog_id, snapshot_id, CAST(14 AS bigint), CAST(10 - i AS double), concat('label ', i)
FROM (SELECT catalog_id, snapshot_id, ver, n, EXPLODE(ARR(1, 2, 3)) AS i FROM {entity_base} WHERE what = 'nation') x
WHERE i < 3 OR (ver = 2 AND n % 3 = 0)""",
    "constraints": f"""
SELECT {_HEAD}, CASE WHEN k % 6 = 0 THEN 'pk_order' ELSE {_name("'_pkey'")} END AS conname, 10 + 4 * k AS conrelid, 'p' AS contype,
       CASE WHEN k % 4 = 0 THEN ARR(2, 1) ELSE ARR(1) END AS conkey, CAST(0 AS bigint) AS confrelid, NO_INTS AS confkey,
       ' ' AS confdeltype, ' ' AS confupdtype, ' ' AS confmatchtype, false AS condeferrable, false AS condeferred, true AS convalidated,
       (10 + 4 * k) * 10 + 1 AS conindid, CAST(0 AS bigint) AS conparentid,
       CASE WHEN k % 4 = 0 THEN 'PRIMARY KEY (customer_id, id)' WHEN k % 18 = 1 THEN 'PRIMARY KEY (id) INCLUDE (customer_id)' ELSE 'PRIMARY KEY (id)' END AS definition
FROM {{order_base}} WHERE k % 11 <> 0 AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, {_name("'_customer_id_key'")}, 10 + 4 * k, 'u', CASE WHEN k % 8 = 1 THEN ARR(2, 1) ELSE ARR(2) END, CAST(0 AS bigint), NULL,
       ' ', ' ', ' ', false, false, true, (10 + 4 * k) * 10 + 2, CAST(0 AS bigint),
       CASE WHEN k % 8 = 1 THEN 'UNIQUE (customer_id, id)' WHEN k % 16 = 5 THEN 'UNIQUE NULLS NOT DISTINCT (customer_id)' ELSE 'UNIQUE (customer_id)' END
FROM {{order_base}} WHERE k % 4 = 1 AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, {_name("'_check'")}, 10 + 4 * k, 'c', ARR(1), CAST(0 AS bigint), NULL, ' ', ' ', ' ', false, false, true, CAST(0 AS bigint),
       CAST(CASE WHEN k % 27 = 0 THEN 1 ELSE 0 END AS bigint), CASE WHEN ver = 2 AND k % 47 = 0 THEN 'CHECK (id > 1)' ELSE 'CHECK (id > 0)' END
FROM {{order_base}} WHERE k % 3 = 0
UNION ALL
SELECT {_HEAD}, CASE WHEN k % 14 = 0 THEN concat('fk_cust_', k) ELSE {_name("'_customer_id_fkey'")} END, 10 + 4 * k, 'f', ARR(2), 11 + 4 * c, ARR(1),
       CASE k % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'r' WHEN 2 THEN 'c' WHEN 3 THEN 'n' ELSE 'x' END, CASE WHEN k % 7 = 0 THEN 'c' ELSE 'a' END,
       CASE WHEN k % 9 = 0 THEN 'f' ELSE 's' END, k % 6 = 0, k % 12 = 0, k % 8 <> 0, CAST(0 AS bigint), CAST(0 AS bigint),
       concat('FOREIGN KEY (customer_id) REFERENCES ', customer_schema, '.customer_', c, '(id)',
              CASE WHEN k % 9 = 0 THEN ' MATCH FULL' ELSE '' END, CASE WHEN k % 7 = 0 THEN ' ON UPDATE CASCADE' ELSE '' END,
              CASE k % 5 WHEN 1 THEN ' ON DELETE RESTRICT' WHEN 2 THEN ' ON DELETE CASCADE' WHEN 3 THEN ' ON DELETE SET NULL' ELSE '' END,
              CASE WHEN k % 6 = 0 THEN ' DEFERRABLE' ELSE '' END, CASE WHEN k % 12 = 0 THEN ' INITIALLY DEFERRED' ELSE '' END,
              CASE WHEN k % 8 = 0 THEN ' NOT VALID' ELSE '' END, CASE WHEN k % 10 = 7 THEN ' /* kept */' ELSE '' END)
FROM {{order_base}} WHERE k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, {_name("'_'", 'attname', "'_fkey'")}, 10 + 4 * k, 'f', ARR(2 + ln), 12 + 4 * p, ARR(1),
       'a', 'a', 's', false, false, true, CAST(0 AS bigint), CAST(0 AS bigint),
       concat('FOREIGN KEY (', quoted_attname, ') REFERENCES parts.part_', p, '(id)')
FROM {{line_base}} WHERE rf = 'A' AND p % 25 = n AND NOT dropped AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, {_name("'_supplier_'", 'ln')}, 10 + 4 * k, 'f', ARR(2, 2 + ln), 13 + 4 * s, ARR(2, 1),
       'a', 'c', 's', true, true, true, CAST(0 AS bigint), CAST(0 AS bigint),
       concat('FOREIGN KEY (customer_id, ', quoted_attname, ') REFERENCES parts.supplier_', s, '(region, id) ON UPDATE CASCADE DEFERRABLE INITIALLY DEFERRED')
FROM {{line_base}} WHERE sn = n AND NOT dropped AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, CASE WHEN what = 'nation' THEN 'nation_pkey' ELSE concat(what, '_', k, '_pkey') END,
       CASE what WHEN 'nation' THEN 1 WHEN 'customer' THEN 11 + 4 * k WHEN 'part' THEN 12 + 4 * k ELSE 13 + 4 * k END, 'p', ARR(1), CAST(0 AS bigint), NULL,
       ' ', ' ', ' ', false, false, true, CAST(0 AS bigint), CAST(0 AS bigint), 'PRIMARY KEY (id)'
FROM {{entity_base}}
UNION ALL
SELECT {_HEAD}, concat('customer_', k, '_nation_id_fkey'), 11 + 4 * k, 'f', ARR(2), CAST(1 AS bigint), ARR(1), 'a', 'a', 's', false, false, true,
       CAST(0 AS bigint), CAST(0 AS bigint), 'FOREIGN KEY (nation_id) REFERENCES sales.nation(id)'
FROM {{entity_base}} WHERE what = 'customer'""",
    "indexes": f"""
SELECT {_HEAD}, (10 + 4 * k) * 10 + 1 AS indexrelid, 10 + 4 * k AS indrelid, {_name("'_pkey'")} AS relname, 'btree' AS amname,
       true AS indisunique, true AS indisprimary, true AS indisvalid, CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS int) AS indnkeyatts,
       CASE WHEN k % 4 = 0 THEN ARR(2, 1) ELSE ARR(1) END AS indkey, CASE WHEN k % 4 = 0 THEN ARR('customer_id', 'id') ELSE ARR('id') END AS key_defs,
       CAST(NULL AS string) AS predicate,
       concat('CREATE UNIQUE INDEX ', {_quoted("'_pkey'")}, ' ON ', {_ID}, ' USING btree ', CASE WHEN k % 4 = 0 THEN '(customer_id, id)' ELSE '(id)' END) AS definition
FROM {{order_base}} WHERE k % 11 <> 0 AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, (10 + 4 * k) * 10 + 2, 10 + 4 * k, {_name("'_customer_id_key'")}, 'btree', true, false, true,
       CAST(CASE WHEN k % 8 = 1 THEN 2 ELSE 1 END AS int), CASE WHEN k % 8 = 1 THEN ARR(2, 1) ELSE ARR(2) END,
       CASE WHEN k % 8 = 1 THEN ARR('customer_id', 'id') ELSE ARR('customer_id') END, NULL,
       concat('CREATE UNIQUE INDEX ', {_quoted("'_customer_id_key'")}, ' ON ', {_ID}, ' USING btree ', CASE WHEN k % 8 = 1 THEN '(customer_id, id)' ELSE '(customer_id)' END)
FROM {{order_base}} WHERE k % 4 = 1 AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, (10 + 4 * k) * 10 + 3, 10 + 4 * k, {_name("'_customer_id_idx'")}, CASE WHEN k % 21 = 0 THEN 'hash' ELSE 'btree' END,
       false, false, NOT (k % 15 = 0 OR (ver = 2 AND k % 43 = 0)), CAST(1 AS int), ARR(2), ARR('customer_id'),
       CASE WHEN k % 3 = 1 THEN '(customer_id IS NOT NULL)' ELSE NULL END,
       concat(CASE WHEN k % 33 = 0 THEN 'CREATE INDEX CONCURRENTLY ' ELSE 'CREATE INDEX ' END, {_quoted("'_customer_id_idx'")},
              CASE WHEN k % 10 = 2 THEN ' ON ONLY ' ELSE ' ON ' END, {_ID}, CASE WHEN k % 21 = 0 THEN ' USING hash (customer_id)' ELSE ' USING btree (customer_id)' END,
              CASE WHEN k % 3 = 1 THEN ' WHERE (customer_id IS NOT NULL)' ELSE '' END)
FROM {{order_base}} WHERE k % 3 <> 2 AND k % 10 BETWEEN 1 AND 8
UNION ALL
SELECT {_HEAD}, (10 + 4 * k) * 10 + 4, 10 + 4 * k, {_name("'_expr_idx'")}, 'btree', k % 26 = 0, false, k % 26 <> 0, CAST(1 AS int), ARR(0, 2), ARR('lower((id)::text)'), NULL,
       concat('CREATE ', CASE WHEN k % 26 = 0 THEN 'UNIQUE ' ELSE '' END, 'INDEX ', {_quoted("'_expr_idx'")}, ' ON ', {_ID}, ' USING btree (lower((id)::text)) INCLUDE (customer_id)')
FROM {{order_base}} WHERE k % 4 = 2 AND k % 10 BETWEEN 2 AND 8
UNION ALL
SELECT {_HEAD}, (10 + 4 * k) * 100 + 50 + ln, 10 + 4 * k, {_name("'_cover_'", 'ln')}, 'btree', false, false, true, CAST(3 AS int), ARR(2 + ln, 2, 1),
       ARR(quoted_attname, 'customer_id', 'id'), NULL,
       concat('CREATE INDEX ', {_quoted("'_cover_'", 'ln')}, ' ON ', {_ID}, ' USING btree (', quoted_attname, ', customer_id, id)')
FROM {{line_base}} WHERE sn = n AND NOT dropped AND k % 10 BETWEEN 2 AND 8 AND ln % 2 = 0
UNION ALL
SELECT {_HEAD}, (11 + 4 * k) * 10 + 1, 11 + 4 * k, concat('customer_', k, '_nation_id_idx'), 'btree', false, false, true, CAST(1 AS int), ARR(2), ARR('nation_id'), NULL,
       concat('CREATE INDEX customer_', k, '_nation_id_idx ON ', CASE WHEN k % 10 = 0 THEN 'ext' ELSE 'sales' END, '.customer_', k, ' USING btree (nation_id)')
FROM {{entity_base}} WHERE what = 'customer' AND k % 2 = 0""",
}


_BS = "chr(92)"
_NL = "chr(10)"

# Note pages of the orders named like documents; hashes are those of snapshot s1.
PAGES = f"""
SELECT catalog_id, relation_id, schema, path, CASE WHEN k % 5 = 0 THEN replace(body, chr(10), concat(chr(13), chr(10))) ELSE body END AS text
FROM (
SELECT catalog_id, relation_id, schema, path, k, concat(
  CASE WHEN k % 29 = 0 THEN '' ELSE concat('---', {_NL}) END,
  '{{{{"version":', CASE WHEN k % 53 = 0 THEN '2' ELSE '1' END,
  ',"table":"', CASE WHEN k % 59 = 0 THEN 'x.y' ELSE replace(relation_id, '"', concat({_BS}, '"')) END,
  '","purpose":', CASE WHEN k % 37 = 0 THEN '42' WHEN k % 3 = 0 THEN '""' WHEN k % 3 = 1 THEN concat('"About ', lang, {_BS}, 'u0007 documents "')
                       ELSE concat('"', replace(replace(replace(doc, '"', ' '), {_BS}, ' '), {_NL}, ' '), '"') END,
  ',"owner":', CASE WHEN k % 61 = 0 THEN '{{{{"a":1}}}}' WHEN k % 4 = 0 THEN 'null' ELSE concat('"', source, '"') END,
  CASE WHEN k % 83 = 0 THEN ',"owner":"again"' ELSE '' END,
  ',"tags":', CASE WHEN k % 41 = 0 THEN '"core"' WHEN k % 67 = 0 THEN '[1]' WHEN k % 6 = 0 THEN '[]' ELSE concat('["', lang, '","', source, '"]') END,
  ',"columns":', CASE WHEN k % 43 = 0 THEN '["id"]' WHEN k % 97 = 0 THEN 'null' ELSE concat('{{{{"id":{{{{"note":"key a/b ', k, '","sensitive":',
        CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END, '}}}},"customer_email_1":{{{{"sensitive":false}}}},"gone_', k % 9, '":',
        CASE WHEN k % 47 = 0 THEN '{{{{"sensitive":"yes"}}}}' WHEN k % 71 = 0 THEN '"note"' WHEN k % 73 = 0 THEN '{{{{"note":1}}}}' ELSE '{{{{}}}}' END,
        ',"customer_id":null}}}}') END,
  ',"custom":[1,2]', CASE WHEN k % 79 = 0 THEN '' ELSE '}}}}' END, {_NL},
  CASE WHEN k % 89 = 0 THEN '' ELSE concat('---', {_NL}) END, {_NL}, '# ', relation_id, {_NL}, {_NL},
  CASE WHEN k % 19 = 0 THEN '<!-- auto:end -->' ELSE '<!-- auto:start -->' END, {_NL},
  CASE WHEN k % 23 = 0 THEN '<!-- state:gone -->' WHEN k % 7 = 0 THEN '<!-- state:removed -->' WHEN k % 11 = 0 THEN '<!-- state:out_of_scope -->' ELSE '<!-- state:active -->' END, {_NL},
  '<!-- hash:', CASE WHEN k % 31 = 0 THEN repeat('0', 64) ELSE hash END, ' -->', {_NL}, '<!-- doc-hash:', doc_hash, ' -->', {_NL},
  CASE WHEN k % 7 = 0 AND k % 2 = 0 THEN concat('> Removed: not in the database at the last capture. The text below is the last description.', {_NL}, {_NL}) ELSE '' END,
  'Description of ', relation_id, {_NL},
  CASE WHEN k % 13 = 0 THEN 'no end' WHEN k % 19 = 0 THEN '<!-- auto:start -->' ELSE '<!-- auto:end -->' END, {_NL},
  CASE WHEN k % 17 = 0 THEN concat('<!-- auto:start -->', {_NL}) ELSE '' END, {_NL}, '## Notes', {_NL}, {_NL}, doc, {_NL}) AS body
FROM (SELECT b.catalog_id, b.relation_id, b.schema, concat('pages/', b.schema, '.', b.k, '.md') AS path, b.k, d.lang, d.source, d.text AS doc,
             coalesce(h.hash, repeat('0', 64)) AS hash, coalesce(h.doc_hash, repeat('0', 64)) AS doc_hash
      FROM (SELECT catalog_id, k, schema_name AS schema, {_ID} AS relation_id FROM {{order_base}} WHERE ver = 1) b
      JOIN {{documents}} d ON d.doc_id = b.k
      LEFT JOIN (SELECT catalog_id, relation_id, hash, doc_hash FROM {{hashes}} WHERE snapshot_id = 's1') h
        ON h.catalog_id = b.catalog_id AND h.relation_id = b.relation_id) x) y"""

# Files a documentation folder should hold, where they are present.
ARTIFACTS = """
SELECT concat('db', lpad(cast(n_nationkey AS string), 2, '0')) AS catalog_id, file
FROM (SELECT n_nationkey, i, CASE i WHEN 1 THEN 'index.md' WHEN 2 THEN 'rules.md' ELSE 'log.md' END AS file
      FROM (SELECT n_nationkey, EXPLODE(ARR(1, 2, 3)) AS i FROM {nation}) y) x
WHERE (n_nationkey + i) % 4 <> 0"""

# Relation names as people type them, one request per customer; some customers name relations as they are, and some share one large request.
REQUESTS = f"""
SELECT catalog_id, CAST(CASE WHEN c % 7 = 3 THEN -1 - floor(c / 1000) ELSE c END AS bigint) AS request_id, k AS pos,
       CASE WHEN c % 7 = 3 OR c % 3 = 1 THEN {_ID} ELSE CASE k % 6 WHEN 0 THEN concat('ORDER_', k) WHEN 1 THEN concat('  ', {_ID}, ' ') WHEN 2 THEN {_quoted()}
                  WHEN 3 THEN concat('"ORDER_', k, '"') WHEN 4 THEN concat('a.b.', k) ELSE concat('Sales.Customer_', c) END END AS input
FROM {{order_base}} WHERE ver = 2"""

TABLES = ["orders", "customer", "lineitem", "supplier", "part", "nation"]
#: Extracts that are stored; the others only name and print what these hold, row by row.
STORED = ["order_base", "line_base", "entity_base", "namespaces", "scopes", "types", "enum_labels"]


def dialect(statement: str, array: str, explode: str, no_ints: str) -> str:
    return (
        statement.replace("ARR(", f"{array}(").replace("EXPLODE(", f"{explode}(").replace("NO_INTS", no_ints)
    )


def _run(spark: SparkSession, statement: str, frames: Tables) -> DataFrame:
    text = dialect(statement, "array", "explode", "CAST(NULL AS array<int>)")
    return spark.sql(text, **{key: frames[key] for key in frames if "{" + key + "}" in text})


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines dealt by order: lines are grouped, and their orders joined, where that has put them."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").repartition("l_orderkey")


def derive(spark: SparkSession, folder: str, target: str) -> LazyTables:
    """The raw extract tables of ``raw.py`` plus ``scopes``, each when it is asked for; what is joined or grouped is written below ``target``."""
    frames = LazyTables({
        **{name: lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES},
        "lineitem": lambda: _lines(spark, folder),
        **{name: lambda name=name: land(_run(spark, STATEMENTS[name], frames), f"{target}/{name}") for name in STORED}})
    return printed(spark, LazyTables({name: lambda name=name: frames[name] for name in STORED}))


def printed(spark: SparkSession, stored: Tables) -> LazyTables:
    """All extracts from the stored ones, or from a part of their rows."""
    makers = {name: lambda name=name: stored[name] for name in stored}
    for name in STATEMENTS:
        makers.setdefault(name, lambda name=name: _run(spark, STATEMENTS[name], stored))
    return LazyTables(makers)


def documented(spark: SparkSession, folder: str, target: str, extracts: Tables) -> LazyTables:
    """Extracts of the orders that a document is named like; everything else, which they refer to, is whole."""
    numbers = small(spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("k")).distinct())
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").join(numbers.select(F.col("k").alias("l_orderkey")), "l_orderkey", "left_semi")
    part = LazyTables({
        "lineitem": lambda: lines, "supplier": lambda: spark.read.parquet(f"{folder}/supplier.parquet"),
        "order_base": lambda: extracts["order_base"].join(numbers, "k", "left_semi").select(*extracts["order_base"].columns),
        "line_base": lambda: land(_run(spark, STATEMENTS["line_base"], part), f"{target}/line_base")})
    return printed(spark, LazyTables({name: (lambda name=name: part[name]) if name in part else (lambda name=name: extracts[name]) for name in STORED}))


def derive_more(spark: SparkSession, folder: str, target: str, base: Tables) -> LazyTables:
    """Pages, artifacts and name requests, once the hashes of ``s1`` are known."""
    frames = LazyTables({
        **{name: lambda name=name: base[name] for name in base},
        **{name: lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "nation")}})
    statements = {"note_pages": PAGES, "artifacts": ARTIFACTS, "requests": REQUESTS}
    return LazyTables({name: lambda name=name: land(_run(spark, statements[name], frames), f"{target}/{name}") for name in statements})
