"""DuckDB SQL for ``plans.catalog_checks``."""

from __future__ import annotations

from tierlake.plans.oracle import RAW_ORDER_ITEMS
from tierlake.plans.oracle_ops import ORACLE_OPS
from tierlake.plans.oracle_dims import (RAW_BRANDS_FROM_NATION, RAW_CATEGORY_FROM_REGION,
                                        RAW_PRODUCTS_FROM_SUPPLIER, SILVER_BRANDS, SILVER_CATEGORY)

_ID = "'{}_' || CAST({} AS VARCHAR)"
_PARTS = "(SELECT p_partkey AS id, p_size FROM part) CROSS JOIN n"
_SUPPLIERS = "(SELECT s_suppkey AS id FROM supplier) CROSS JOIN n"


def _rule(name: str, column: str, kind: str, failed: str, source: str, status: str | None = None) -> str:
    status = status or f"CASE WHEN ({failed}) > 0 THEN 'FAILED' ELSE 'PASSED' END"
    total = "0" if column == "l_comment" else "n.total"
    return (f"SELECT {_ID.format(name, 'id')} AS rule_id, 'lineitem' AS table_name, '{column}' AS column_name, "
            f"'{kind}' AS rule_type, CASE WHEN id % 2 = 0 THEN 'WARN' ELSE 'ERROR' END AS severity, "
            f"CAST({failed} AS BIGINT) AS failed_rows, CAST({total} AS BIGINT) AS total_rows, {status} AS status "
            f"FROM {source}")


_RULES_TABLE = " UNION ALL ".join([
    _rule("qty_min", "l_quantity", "min",
          "coalesce(list_sum([x.n FOR x IN n.quantities IF x.v < p_size]), 0)", _PARTS),
    _rule("qty_max", "l_quantity", "max",
          "coalesce(list_sum([x.n FOR x IN n.quantities IF x.v > p_size]), 0)", _PARTS),
    _rule("line_set", "l_linenumber", "in_set",
          "coalesce(list_sum([x.n FOR x IN n.lines IF x.v > p_size % 9 + 1 OR x.v < 1]), 0)", _PARTS),
    _rule("flag_fmt", "l_returnflag", "regex",
          "CASE WHEN id % 3 = 0 THEN n.not_an ELSE n.not_anr END", _SUPPLIERS),
    _rule("flag_set", "l_returnflag", "in_set",
          "CASE WHEN id % 2 = 0 THEN n.not_ar ELSE n.not_anr END", _SUPPLIERS),
    _rule("status_min", "l_linestatus", "min",
          "CASE WHEN id % 2 = 0 THEN n.below_g ELSE n.below_f END", _SUPPLIERS),
    _rule("ship_max", "l_shipdate", "max",
          "coalesce(list_sum([x.n FOR x IN n.days IF x.v > make_date(CAST(id % 7 + 1994 AS INTEGER), 6, 30)]), 0)",
          _SUPPLIERS),
    _rule("ship_nn", "l_shipdate", "not_null", "n.no_day", _SUPPLIERS),
    _rule("disc_nulls", "l_discount", "null_ratio", "n.no_discount", _SUPPLIERS,
          "CASE WHEN n.no_discount > 0.01 * n.total THEN 'FAILED' ELSE 'PASSED' END"),
    _rule("no_column", "l_comment", "not_null", "NULL", _SUPPLIERS, "'INVALID'"),
    _rule("no_value", "l_tax", "min", "NULL", _SUPPLIERS, "'INVALID'"),
])


def _type(table: str, position: int, column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    if column in ("o_orderdate", "l_shipdate"):
        return f"SELECT '{table}' AS table_name, {position} AS position, '{column}' AS column_name, 'timestamp' AS data_type"
    whole = rf"regexp_full_match(t, '[+-]?\d+')"
    return f"""SELECT '{table}' AS table_name, {position} AS position, '{column}' AS column_name, CASE
        WHEN count(t) = 0 THEN 'string'
        WHEN count(t) = count_if({whole} AND try_cast(t AS INTEGER) IS NOT NULL) THEN 'int'
        WHEN count(t) = count_if({whole} AND try_cast(t AS BIGINT) IS NOT NULL) THEN 'bigint'
        WHEN count(t) = count_if(try_cast(t AS DOUBLE) IS NOT NULL) THEN 'double'
        ELSE 'string' END AS data_type FROM (SELECT nullif({text}, '') AS t FROM {table})"""


# The columns of the given tables, in order.
_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
}


def _audit(name: str, left: str, right: str, lk: str, rk: str) -> str:
    """Counts by the real joins."""
    return f"""SELECT '{name}' AS join_name, (SELECT count(*) FROM {left}) AS left_rows,
      (SELECT count(*) FROM {right}) AS right_rows,
      (SELECT count(*) FROM {left} WHERE {lk} IS NULL) AS left_null_keys,
      (SELECT count(*) FROM {right} WHERE {rk} IS NULL) AS right_null_keys,
      (SELECT count(*) FROM {left} l WHERE l.{lk} IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM {right} r WHERE r.{rk} = l.{lk})) AS left_unmatched,
      (SELECT count(*) FROM {right} r WHERE r.{rk} IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM {left} l WHERE r.{rk} = l.{lk})) AS right_unmatched,
      (SELECT count(*) FROM {left} WHERE {lk} IN (
         SELECT {rk} FROM {right} GROUP BY ALL HAVING count(*) > 1)) AS left_multiplied,
      (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM {right} WHERE {rk} IN (
         SELECT {lk} FROM {left}) GROUP BY {rk})) AS max_matches,
      (SELECT count(*) FROM {left} l JOIN {right} r ON l.{lk} = r.{rk}) AS inner_rows,
      (SELECT count(*) FROM {left} l LEFT JOIN {right} r ON l.{lk} = r.{rk}) AS left_join_rows,
      (SELECT count(*) FROM {left} l LEFT JOIN {right} r ON l.{lk} = r.{rk})
        - (SELECT count(*) FROM {left}) AS extra_rows"""


ORACLE_CHECKS = {
    "rules_table": f"""
WITH n AS (
  SELECT count(*) AS total, count(*) - count(l_shipdate) AS no_day, count(*) - count(l_discount) AS no_discount,
         count_if(l_returnflag NOT IN ('A', 'N')) AS not_an, count_if(l_returnflag NOT IN ('A', 'N', 'R')) AS not_anr,
         count_if(l_returnflag NOT IN ('A', 'R')) AS not_ar,
         count_if(l_linestatus < 'G') AS below_g, count_if(l_linestatus < 'F') AS below_f,
         (SELECT list({{'v': l_quantity, 'n': c}}) FROM (
            SELECT l_quantity, count(*) AS c FROM lineitem GROUP BY 1)) AS quantities,
         (SELECT list({{'v': l_linenumber, 'n': c}}) FROM (
            SELECT l_linenumber, count(*) AS c FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 1)) AS lines,
         (SELECT list({{'v': l_shipdate, 'n': c}}) FROM (
            SELECT l_shipdate, count(*) AS c FROM lineitem GROUP BY 1)) AS days
  FROM lineitem)
{_RULES_TABLE}""",
    "rescued_rows": """
SELECT CASE WHEN w IN (1, 2, 4) THEN 'values' WHEN w IN (5, 6) THEN 'fields' ELSE 'fits' END AS reason,
       CASE w WHEN 1 THEN 'o_custkey' WHEN 2 THEN 'o_custkey,o_orderdate' WHEN 4 THEN 'o_orderdate' ELSE '' END AS lost,
       CAST(o_orderkey AS VARCHAR) AS key,
       CASE WHEN w IN (1, 2, 3, 4, 5, 6) THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS price
FROM (SELECT *, o_orderkey % 20 AS w FROM orders)
""",
    "landing_duplicates": f"""
WITH {RAW_ORDER_ITEMS}
SELECT order_id, item_seq, count(*) AS n FROM raw_order_items
WHERE order_id IS NOT NULL AND item_seq IS NOT NULL GROUP BY ALL HAVING count(*) > 1
""",
    "landed_types": " UNION ALL ".join(
        _type(table, i, column) for table, columns in _COLUMNS.items() for i, column in enumerate(columns.split())),
    "join_audit": f"""
WITH {RAW_BRANDS_FROM_NATION}, {RAW_CATEGORY_FROM_REGION}, {RAW_PRODUCTS_FROM_SUPPLIER},
{SILVER_BRANDS}, {SILVER_CATEGORY}
""" + " UNION ALL ".join([
        _audit("brands_category", "silver_brands", "silver_category", "category_code", "category_code"),
        _audit("products_brands", "raw_products", "silver_brands", "brand_code", "brand_code"),
        _audit("orders_lineitem", "orders", "lineitem", "o_orderkey", "l_orderkey"),
        _audit("customer_orders", "customer", "orders", "c_custkey", "o_custkey"),
        _audit("part_lineitem", "part", "lineitem", "p_partkey", "l_partkey"),
    ]),
    "catalog_drift": """
SELECT table_name, CASE data_type WHEN 'FLOAT[]' THEN 'record.' || column_name || '[]'
                                  ELSE 'record.' || column_name END AS column_name,
       'type_change' AS change,
       CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'float' ELSE 'timestamp_ntz' END AS expected_type,
       CASE data_type WHEN 'INTEGER' THEN 'bigint' WHEN 'FLOAT[]' THEN 'double' ELSE 'string' END AS actual_type
FROM duckdb_columns() WHERE data_type IN ('INTEGER', 'FLOAT[]', 'TIMESTAMP') AND table_name IN (
  'region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings',
  'pages', 'benchmark', 'labels', 'conversations')
""",
    "nested_conform": """
SELECT CASE WHEN l_linenumber <> 3 THEN l_orderkey END AS orderkey,
       CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS linenumber,
       CAST(NULL AS VARCHAR) AS note, 'quantity' AS first,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice END AS price,
       CAST(NULL AS VARCHAR) AS unit, CAST(CAST(l_tax AS DECIMAL(10,4)) * 10000 AS BIGINT) AS tax_bp,
       CAST(CAST(l_discount AS DECIMAL(10,4)) * 10000 AS BIGINT) AS discount_bp
FROM lineitem
""",
    "incident_stream": ORACLE_OPS["incident_choice"],
}
