"""DuckDB SQL for ``plans.catalog_ops`` (sources, drift, runs, incidents, rules)."""

from __future__ import annotations

from tierlake.plans.oracle import RAW_ORDER_ITEMS, SILVER_ORDER_ITEMS
from tierlake.plans.oracle_dims import RAW_CUSTOMERS


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def rules_sql(src: str, rules: list[tuple]) -> str:
    """rules: (rule_id, column, rule_type, value, severity, table_name)."""
    aggs = ["count(*) AS _total"]
    for i, (_, c, t, v, _, _) in enumerate(rules):
        if t == "not_null" or t == "null_ratio":
            e = f"{c} IS NULL"
        elif t == "min":
            e = f"{c} < {_lit(v)}"
        elif t == "max":
            e = f"{c} > {_lit(v)}"
        elif t == "in_set":
            e = f"{c} IS NOT NULL AND NOT {c} IN ({', '.join(_lit(x) for x in v)})"
        elif t == "regex":
            e = f"{c} IS NOT NULL AND NOT regexp_matches({c}, {_lit(v)})"
        elif t == "zscore":
            mean, std = f"(SELECT avg({c}) FROM {src})", f"(SELECT stddev_samp({c}) FROM {src})"
            e = f"{std} > 0 AND abs({c} - {mean}) / {std} > {_lit(float(v))}"
        else:
            raise ValueError(t)
        aggs.append(f"count_if({e}) AS _r{i}")
    rows = []
    for i, (rid, c, t, v, sev, tbl) in enumerate(rules):
        if t == "null_ratio":
            bad = f"_total > 0 AND _r{i} / _total > {_lit(float(v))}"
        else:
            bad = f"_r{i} > 0"
        rows.append(f"SELECT '{rid}' AS rule_id, '{tbl}' AS table_name, '{c}' AS column_name, "
                    f"'{t}' AS rule_type, '{sev}' AS severity, CAST(_r{i} AS BIGINT) AS failed_rows, "
                    f"CAST(_total AS BIGINT) AS total_rows, "
                    f"CASE WHEN {bad} THEN 'FAILED' ELSE 'PASSED' END AS status FROM _agg")
    return f"(WITH _agg AS (SELECT {', '.join(aggs)} FROM {src}) {' UNION ALL '.join(rows)})"


_DOC_RUNS = """
        d AS (SELECT doc_id, lang, toxic, quality FROM documents JOIN labels USING (doc_id)),
        newest AS (SELECT lang, max(doc_id) FILTER (toxic = 1) AS f,
                          max(doc_id) FILTER (quality = 0) AS a FROM d GROUP BY lang),
        inc AS (SELECT lang, CASE WHEN f > coalesce(a, -1) THEN 'failure' ELSE 'anomaly' END AS kind,
                       greatest(coalesce(f, a), coalesce(a, f)) AS doc
                FROM newest WHERE coalesce(f, a) IS NOT NULL)"""
_DOC_EDGES = "edges AS (SELECT doc_id AS child, doc_id // 2 AS parent FROM documents WHERE doc_id > 0)"
_INCIDENT_DOCS = "SELECT DISTINCT doc_id FROM labels WHERE quality = 0"

ORACLE_OPS: dict[str, str] = {
    "csv_round_trip": "SELECT *, TRUE AS from_csv FROM customer",
    "json_events_round_trip": "SELECT * FROM events",
    "catalog_round_trip": "SELECT * FROM part",
    "quarantine_round_trip": f"WITH {RAW_CUSTOMERS} SELECT 'NULL_PRIMARY_KEY' AS error_type, "
                             "'NOT_ATTEMPTED' AS repair_status, * FROM raw_customers "
                             "WHERE customer_id IS NULL",
    "schema_drift": """
        SELECT * FROM (VALUES
          ('s_acctbal', 'type_change', 'float', 'double', FALSE),
          ('s_phone', 'missing', 'string', CAST(NULL AS VARCHAR), FALSE),
          ('s_comment', 'extra', CAST(NULL AS VARCHAR), 'string', TRUE)
        ) t(column_name, change, expected_type, actual_type, compatible)""",
    "schema_conform": "SELECT s_suppkey, s_name, CAST(NULL AS INTEGER) AS s_nationkey, s_acctbal "
                      "FROM supplier",
    "landing_ingest": f"WITH {RAW_ORDER_ITEMS} SELECT * FROM raw_order_items",
    "run_status": """
        SELECT 'bronze' AS stage_name, 'bronze_orders' AS pipeline_name, 'SUCCESS' AS status,
               CAST(count(*) AS BIGINT) AS row_count FROM orders
        UNION ALL
        SELECT 'silver', 'silver_orders', 'SUCCESS', CAST(count(DISTINCT o_orderkey) AS BIGINT) FROM orders
        UNION ALL
        SELECT 'gold', 'gold_orders', 'SUCCESS', CAST(count(DISTINCT o_orderkey) AS BIGINT) FROM orders
        UNION ALL
        SELECT 'gold', 'gold_order_priority', 'FAILED', CAST(0 AS BIGINT)""",
    "resumed_run": """
        WITH gold AS (SELECT DISTINCT o_custkey FROM orders SEMI JOIN customer ON o_custkey = c_custkey),
        r AS (
          SELECT 'bronze' AS stage_name, 'bronze_orders' AS pipeline_name, 'SUCCESS' AS status,
                 0 AS retry_count, count(*) AS row_count FROM orders
          UNION ALL SELECT 'bronze', 'bronze_customers', 'SUCCESS', 0, count(*) FROM customer
          UNION ALL SELECT 'silver', 'silver_orders', 'RETRYING', unnest([0, 1]), 0
          UNION ALL SELECT 'silver', 'silver_orders', 'SUCCESS', 2, count(DISTINCT o_orderkey) FROM orders
          UNION ALL SELECT 'gold', 'gold_customers', 'RETRYING', unnest([0, 1]), 0
          UNION ALL SELECT 'gold', 'gold_customers', 'FAILED', 2, 0
          UNION ALL SELECT 'gold', 'gold_customers', 'SUCCESS', 0, count(*) FROM gold)
        SELECT stage_name, pipeline_name, status, CAST(retry_count AS INTEGER) AS retry_count,
               CAST(row_count AS BIGINT) AS row_count FROM r""",
    "lineage_capture": """
        SELECT * FROM (VALUES
          ('bronze.orders', 'raw_to_bronze_load', 'raw/orders'),
          ('silver.orders', 'bronze_to_silver_transformation', 'bronze.orders'),
          ('gold.orders', 'silver_to_gold_aggregation', 'silver.orders'),
          ('gold.order_priority', 'silver_to_gold_aggregation', 'silver.orders')
        ) t(downstream_table, operation, upstream)""",
    "validation_events": """
        WITH c AS (
          SELECT CAST(count_if(o_totalprice < 0) AS BIGINT) AS n_price,
                 CAST(count_if(o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('O', 'F'))
                      AS BIGINT) AS n_status,
                 CAST(count_if(o_orderpriority IS NOT NULL
                               AND NOT regexp_matches(trim(o_orderpriority), '^[1-5]-[A-Z ]+$'))
                      AS BIGINT) AS n_prio
          FROM orders)
        SELECT 'o_price_min' AS rule_id, 'min' AS validation_type,
               CASE WHEN n_price > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, n_price AS failed_rows
        FROM c
        UNION ALL
        SELECT 'o_status_set', 'in_set', CASE WHEN n_status > 0 THEN 'FAILED' ELSE 'PASSED' END,
               n_status FROM c
        UNION ALL
        SELECT 'o_prio_fmt', 'regex', CASE WHEN n_prio > 0 THEN 'FAILED' ELSE 'PASSED' END,
               n_prio FROM c""",
    "incident_origin": """
        SELECT * FROM (VALUES
          ('failure', 'gold.order_priority', 'bronze.orders', 2, 1, 1),
          ('failure', 'gold.order_priority', 'gold.order_priority', 0, 3, 2)
        ) t(incident_type, incident_table, node, depth, severity, rank)""",
    "diagnose_batches": f"""
        WITH RECURSIVE {_DOC_RUNS},
        evi AS (SELECT lang, doc_id, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2
                       WHEN lang <> 'en' AND doc_id % 7 = 0 THEN 1 END AS severity FROM d),
        walk(lang, node, depth) AS (
          SELECT lang, doc, 0 FROM inc
          UNION ALL
          SELECT w.lang, d.doc_id // 2, w.depth + 1
          FROM walk w JOIN d ON d.lang = w.lang AND d.doc_id = w.node AND d.doc_id > 0),
        near AS (SELECT lang, node, min(depth) AS depth FROM walk GROUP BY lang, node)
        SELECT inc.lang AS batch_id, inc.kind AS incident_type,
               CAST(inc.doc AS VARCHAR) AS incident_table, CAST(n.node AS VARCHAR) AS node,
               CAST(n.depth AS INTEGER) AS depth, evi.severity,
               CAST(row_number() OVER (PARTITION BY inc.lang ORDER BY n.depth DESC,
                    evi.severity DESC, n.node) AS INTEGER) AS rank
        FROM inc JOIN near n ON n.lang = inc.lang
        JOIN evi ON evi.lang = n.lang AND evi.doc_id = n.node
        WHERE evi.severity IS NOT NULL""",
    "stage_evidence": f"""
        WITH {_DOC_RUNS}, top AS (SELECT doc FROM inc ORDER BY doc DESC LIMIT 1),
        run AS (SELECT * FROM d WHERE doc_id = (SELECT doc FROM top))
        SELECT lang AS batch_id, CAST(doc_id AS VARCHAR) AS stage_run_id, event_type,
               CASE WHEN event_type = 'execution'
                    THEN CASE WHEN toxic = 1 THEN 'FAILED' ELSE 'SUCCESS' END END AS status,
               CASE WHEN event_type = 'lineage' THEN CAST(doc_id AS VARCHAR) END AS downstream_table
        FROM run, (VALUES ('lineage'), ('execution'), ('anomaly'), ('schema_drift')) k(event_type)
        WHERE event_type IN ('lineage', 'execution')
           OR (event_type = 'anomaly' AND quality = 0)
           OR (event_type = 'schema_drift' AND lang <> 'en' AND doc_id % 7 = 0)""",
    "telemetry_damage": """
        SELECT reason, count(*) AS n_lines FROM (
          SELECT CASE event_id % 10 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'bad value'
                 WHEN 2 THEN 'bad value' WHEN 3 THEN 'no timestamp' ELSE 'kept' END AS reason
          FROM events WHERE event_id IS NOT NULL) GROUP BY reason""",
    "latest_failure": """
        SELECT user_id, ts, event_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id
                                       ORDER BY ts DESC, event_id DESC) AS rn
          FROM events WHERE event_type = 'error') WHERE rn = 1""",
    "latest_anomaly": """
        SELECT user_id, ts, event_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id
                                       ORDER BY ts DESC, event_id DESC) AS rn
          FROM events WHERE event_type = 'signup') WHERE rn = 1""",
    "incident_choice": """
        WITH cand AS (
          SELECT user_id, ts, event_id, 0 AS prio, 'failure' AS incident_type
          FROM events WHERE event_type = 'error'
          UNION ALL
          SELECT user_id, ts, event_id, 1 AS prio, 'anomaly' AS incident_type
          FROM events WHERE event_type = 'signup')
        SELECT user_id, incident_type, ts, event_id FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id
                                       ORDER BY ts DESC, prio DESC, event_id DESC) AS rn
          FROM cand) WHERE rn = 1""",
    "stage_context": """
        SELECT user_id,
               CAST(count_if(event_type = 'view') AS BIGINT) AS n_view,
               CAST(count_if(event_type = 'signup') AS BIGINT) AS n_signup,
               CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_purchase,
               CAST(count_if(event_type = 'error') AS BIGINT) AS n_error,
               CAST(count_if(event_type = 'click') AS BIGINT) AS n_click,
               min(ts) AS first_ts, max(ts) AS last_ts
        FROM events GROUP BY user_id""",
    "incident_lineage": """
        WITH lin AS (
          SELECT CAST(doc_id AS VARCHAR) AS artifact_id, CAST(doc_id AS VARCHAR) AS downstream_table,
                 CASE WHEN doc_id > 0 THEN CAST(doc_id // 2 AS VARCHAR) ELSE '' END AS upstream,
                 'derive' AS operation
          FROM documents)
        SELECT l.doc_id, lin.downstream_table, lin.operation, lin.upstream
        FROM labels l LEFT JOIN lin ON lin.artifact_id = CAST(l.doc_id AS VARCHAR)
        WHERE l.quality = 0""",
    "direct_upstream": """
        WITH lin AS (
          SELECT lang AS batch_id, source AS stage_run_id, CAST(doc_id AS VARCHAR) AS artifact_id,
                 CAST(doc_id AS VARCHAR) AS downstream_table
          FROM documents),
        edges AS (
          SELECT DISTINCT lang AS batch_id, CAST(doc_id AS VARCHAR) AS child,
                 CAST(doc_id // 2 AS VARCHAR) AS parent
          FROM documents WHERE doc_id > 0),
        inc AS (
          SELECT batch_id, downstream_table AS child FROM lin
          WHERE artifact_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0))
        SELECT e.batch_id, e.child, e.parent, p.stage_run_id, p.artifact_id, 'derive' AS operation
        FROM inc JOIN edges e ON e.batch_id = inc.batch_id AND e.child = inc.child
        JOIN lin p ON p.batch_id = e.batch_id AND p.downstream_table = e.parent""",
    "lineage_closure": f"""
        WITH RECURSIVE {_DOC_EDGES},
        walk(node, depth) AS (
          SELECT doc_id, 0 FROM ({_INCIDENT_DOCS})
          UNION ALL
          SELECT e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.node)
        SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""",
    "root_cause_rank": f"""
        WITH RECURSIVE {_DOC_EDGES},
        walk(start, node, depth) AS (
          SELECT doc_id, doc_id, 0 FROM ({_INCIDENT_DOCS})
          UNION ALL
          SELECT w.start, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.node),
        closure AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node),
        ev AS (SELECT doc_id AS node,
                      CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 END AS severity
               FROM labels),
        cand AS (SELECT c.start, c.node, c.depth, ev.severity
                 FROM closure c JOIN ev ON ev.node = c.node WHERE ev.severity IS NOT NULL)
        SELECT node, start, CAST(depth AS INTEGER) AS depth, severity, CAST(rn AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY start
                                           ORDER BY depth DESC, severity DESC, node ASC) AS rn
              FROM cand) WHERE rn <= 1""",
    "rules_basic": "SELECT * FROM " + rules_sql("lineitem", [
        ("li_ship_nn", "l_shipdate", "not_null", None, "ERROR", "lineitem"),
        ("li_qty_min", "l_quantity", "min", 1.0, "ERROR", "lineitem"),
        ("li_disc_max", "l_discount", "max", 0.08, "WARN", "lineitem"),
        ("li_flag_set", "l_returnflag", "in_set", ["R", "A"], "ERROR", "lineitem"),
        ("li_tax_min", "l_tax", "min", 0.0, "ERROR", "lineitem"),
    ]),
    "rules_regex": "SELECT * FROM " + rules_sql("customer", [
        ("cu_name_fmt", "c_name", "regex", r"^Customer#\d{9}$", "ERROR", "customer"),
        ("cu_seg_fmt", "c_mktsegment", "regex", r"^[A-Z]+$", "ERROR", "customer"),
        ("cu_name_low", "c_name", "regex", r"^Customer#0000000[0-4]", "WARN", "customer"),
    ]),
    "rules_zscore": "SELECT * FROM " + rules_sql("lineitem", [
        ("li_price_z", "l_extendedprice", "zscore", 2.0, "ERROR", "lineitem"),
        ("li_qty_z", "l_quantity", "zscore", 1.5, "WARN", "lineitem"),
    ]),
    "rules_null_ratio": f"WITH {SILVER_ORDER_ITEMS} SELECT * FROM " + rules_sql("silver_items", [
        ("oi_qty_nulls", "quantity", "null_ratio", 0.01, "ERROR", "slv_order_items"),
        ("oi_price_nulls", "unit_price", "null_ratio", 0.5, "ERROR", "slv_order_items"),
        ("oi_tax_nulls", "tax_amount", "null_ratio", 0.02, "ERROR", "slv_order_items"),
        ("oi_dt_nulls", "dt", "null_ratio", 0.1, "ERROR", "slv_order_items"),
    ]),
}


def _dims_run_sql() -> str:
    from tierlake.plans import oracle_dims as D
    ctes = D._w(D.RAW_BRANDS_FROM_NATION, D.SILVER_BRANDS, D.RAW_CATEGORY_FROM_REGION,
                D.SILVER_CATEGORY, D.RAW_PRODUCTS_FROM_SUPPLIER, D.SILVER_PRODUCTS,
                D.GOLD_PRODUCTS, D.RAW_CUSTOMERS, D.SILVER_CUSTOMERS, D.RAW_CALENDAR)
    counts = [
        ("brz_brands", "bronze", "raw_brands"), ("brz_category", "bronze", "raw_category"),
        ("brz_products", "bronze", "raw_products"), ("brz_customers", "bronze", "raw_customers"),
        ("brz_calendar", "bronze", "raw_calendar"),
        ("slv_brands", "silver", "silver_brands"), ("slv_category", "silver", "silver_category"),
        ("slv_products", "silver", "silver_products"),
        ("slv_customers", "silver", "silver_customers"),
        ("slv_date", "silver", "(SELECT DISTINCT try_strptime(date, '%d-%m-%Y') FROM raw_calendar)"),
        ("gld_products", "gold", "gold_products"),
        ("gld_customers", "gold", "silver_customers"),
        ("gld_date", "gold", "(SELECT DISTINCT try_strptime(date, '%d-%m-%Y') FROM raw_calendar)"),
    ]
    body = " UNION ALL ".join(
        f"SELECT '{p}' AS pipeline_name, '{s}' AS stage_name, 'SUCCESS' AS status, "
        f"CAST(count(*) AS BIGINT) AS row_count FROM {src}" for p, s, src in counts)
    return f"{ctes} {body}"


ORACLE_OPS["dims_run"] = _dims_run_sql()
