"""DuckDB SQL for the query catalog (``plans.catalog``).

Each string is an independent statement over the driver's pre-registered
views. Shared projections are CTE fragments assembled here, so the dirty
input and the lenient parsing read the same in every query.

Engine differences handled here: DuckDB ``regexp_replace`` needs flag 'g'
to replace every match; ``ceil`` returns DOUBLE and integer ``sum`` /
``count_if`` return HUGEINT, so both are cast to BIGINT; decimal literals
are cast to DOUBLE; a plain ``try_cast('2.7' as int)`` rounds, so the
integer parse truncates explicitly.
"""

from __future__ import annotations

INT_TEXT = r"^\s*[+-]?\d+(\.\d*)?\s*$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_int(e: str) -> str:
    return (f"(CASE WHEN regexp_matches(CAST({e} AS VARCHAR), '{INT_TEXT}') "
            f"THEN TRY_CAST(trunc(TRY_CAST(CAST({e} AS VARCHAR) AS DOUBLE)) AS INTEGER) END)")


def to_double(e: str) -> str:
    return (f"(CASE WHEN regexp_matches(CAST({e} AS VARCHAR), '{NUMBER_TEXT}') "
            f"THEN TRY_CAST(CAST({e} AS VARCHAR) AS DOUBLE) END)")


def strip(e: str, pattern: str) -> str:
    return f"regexp_replace({e}, '{pattern}', '', 'g')"


def dec_text(e: str, scale: int) -> str:
    return f"CAST(CAST({e} AS DECIMAL(18,{scale})) AS VARCHAR)"


def pad2(e: str) -> str:
    return f"lpad(CAST({e} AS VARCHAR), 2, '0')"


# --------------------------------------------------------------------------
# Messy order items from lineitem
# --------------------------------------------------------------------------

_HH = pad2("(l_orderkey * 7 + l_linenumber) % 24")
_MI = pad2("(l_orderkey * 13 + l_linenumber * 3) % 60")
_SS = pad2("l_partkey % 60")
_PRICE = dec_text("l_extendedprice", 2)
_PCT = dec_text("l_discount * 100", 2)
_TAX = dec_text("l_tax * 100", 2)

RAW_ORDER_ITEMS = f"""
raw_order_items AS (
  SELECT
    CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate, '%Y/%m/%d')
         ELSE strftime(l_shipdate, '%Y-%m-%d') END AS dt,
    CASE WHEN l_partkey % 101 = 0 THEN 'not a time'
         WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') || ' ' || {_HH} || ':' || {_MI} || ':' || {_SS}
         ELSE strftime(l_shipdate, '%d-%m-%Y') || ' ' || {_HH} || ':' || {_MI} END AS order_ts,
    CAST(l_suppkey AS VARCHAR) AS customer_id,
    CAST(l_orderkey AS VARCHAR) AS order_id,
    CASE WHEN l_partkey % 211 = 0 THEN NULL
         WHEN l_partkey % 50 = 0 THEN '0' || CAST(l_linenumber AS VARCHAR)
         ELSE CAST(l_linenumber AS VARCHAR) END AS item_seq,
    CAST(l_partkey AS VARCHAR) AS product_id,
    CASE WHEN l_quantity = 2 THEN 'Two'
         WHEN l_partkey % 13 = 0 THEN {dec_text('l_quantity', 1)}
         WHEN l_partkey % 97 = 0 THEN 'abc'
         WHEN l_partkey % 89 = 0 THEN NULL
         ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity,
    (['INR', ' usd ', 'AED', 'aud', 'CAD ', 'GBP', 'sgd', 'EUR'])[CAST(l_suppkey % 8 + 1 AS INTEGER)]
      AS unit_price_currency,
    CASE WHEN l_linenumber % 2 = 0 THEN '$' || {_PRICE}
         WHEN l_partkey % 53 = 0 THEN replace({_PRICE}, '.', ',')
         ELSE {_PRICE} END AS unit_price,
    CASE WHEN l_linenumber % 2 = 1 THEN {_PCT} || '%' ELSE {_PCT} END AS discount_pct,
    CASE WHEN l_orderkey % 5 = 0 THEN 'INR ' || {_TAX}
         WHEN l_orderkey % 7 = 0 THEN '-' || {_TAX}
         WHEN l_partkey % 31 = 0 THEN 'n/a'
         ELSE {_TAX} END AS tax_amount,
    CASE WHEN l_linenumber % 3 = 0 THEN 'web' WHEN l_linenumber % 3 = 1 THEN 'app'
         ELSE 'Store' END AS channel,
    CASE WHEN l_returnflag = 'R' THEN ' SAVE10 ' WHEN l_returnflag = 'A' THEN ''
         ELSE NULL END AS coupon_code
  FROM lineitem
)"""

_RAW_ITEM_REST = ["dt", "order_ts", "customer_id", "product_id", "quantity",
                  "unit_price_currency", "unit_price", "discount_pct", "tax_amount",
                  "channel", "coupon_code"]

SILVER_ORDER_ITEMS = RAW_ORDER_ITEMS + f""",
dedup_items AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY order_id, item_seq
      ORDER BY {', '.join(c + ' NULLS FIRST' for c in _RAW_ITEM_REST)}) AS rn
    FROM raw_order_items) WHERE rn = 1
),
silver_items AS (
  SELECT
    CAST(try_strptime(dt, '%Y-%m-%d') AS DATE) AS dt,
    coalesce(try_strptime(order_ts, '%Y-%m-%d %H:%M:%S'),
             try_strptime(order_ts, '%d-%m-%Y %H:%M')) AS order_ts,
    customer_id,
    order_id,
    {to_int('item_seq')} AS item_seq,
    product_id,
    {to_int("CASE WHEN quantity = 'Two' THEN '2' ELSE quantity END")} AS quantity,
    unit_price_currency,
    {to_double(strip('unit_price', '[$]'))} AS unit_price,
    {to_double(strip('discount_pct', '%'))} AS discount_pct,
    {to_double(strip('tax_amount', r'[^0-9.\-]'))} AS tax_amount,
    CASE WHEN channel = 'web' THEN 'Website' WHEN channel = 'app' THEN 'Mobile'
         ELSE channel END AS channel,
    lower(trim(coupon_code)) AS coupon_code
  FROM dedup_items
)"""

FX_RATES = """
fx_rates(currency, inr_rate) AS (
  VALUES ('INR', CAST(1.00 AS DOUBLE)), ('AED', CAST(24.18 AS DOUBLE)),
         ('AUD', CAST(57.55 AS DOUBLE)), ('CAD', CAST(62.93 AS DOUBLE)),
         ('GBP', CAST(117.98 AS DOUBLE)), ('SGD', CAST(68.18 AS DOUBLE)),
         ('USD', CAST(88.29 AS DOUBLE))
)"""

GOLD_ORDER_ITEMS = SILVER_ORDER_ITEMS + "," + FX_RATES + """,
amounts AS (
  SELECT *,
    quantity * unit_price AS gross_amount,
    CAST(ceil(quantity * unit_price * (discount_pct / CAST(100.0 AS DOUBLE))) AS BIGINT)
      AS discount_amount
  FROM silver_items
),
gold_items AS (
  SELECT
    CAST(strftime(dt, '%Y%m%d') AS INTEGER) AS date_id,
    dt AS transaction_date,
    order_ts AS transaction_ts,
    order_id AS transaction_id,
    customer_id,
    item_seq AS seq_no,
    product_id,
    channel,
    coupon_code,
    CASE WHEN coupon_code IS NOT NULL THEN 1 ELSE 0 END AS coupon_flag,
    unit_price_currency,
    quantity,
    unit_price,
    gross_amount,
    discount_pct AS discount_percent,
    discount_amount,
    tax_amount,
    gross_amount - discount_amount + tax_amount AS net_amount,
    CAST(ceil((gross_amount - discount_amount + tax_amount) * r.inr_rate) AS BIGINT)
      AS net_amount_inr
  FROM amounts a LEFT JOIN fx_rates r ON r.currency = upper(trim(a.unit_price_currency))
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


ORACLE: dict[str, str] = {
    "fact_clean": f"WITH {SILVER_ORDER_ITEMS} SELECT * FROM silver_items",
    "fact_mart": f"WITH {GOLD_ORDER_ITEMS} SELECT * FROM gold_items",
}


# --------------------------------------------------------------------------
# Quality findings
# --------------------------------------------------------------------------

def findings_sql(src: str, table_name: str, stage: str = "silver", keys=(), critical=(),
                 metrics=(), numeric=(), min_rows=None, duplicate_check=True) -> str:
    """SELECT producing the findings of one table ``src`` (a view or CTE)."""
    null_cols = list(dict.fromkeys([*critical, *metrics]))
    any_key_null = " OR ".join(f"{k} IS NULL" for k in keys) or "FALSE"
    if keys and duplicate_check:
        inner = ", ".join(
            [*keys, "count(*) AS _n"]
            + [f"count_if({c} IS NULL) AS \"null__{c}\"" for c in null_cols]
            + [f"count_if({c} < 0) AS \"neg__{c}\"" for c in numeric])
        cols = ["CAST(coalesce(sum(_n), 0) AS BIGINT) AS row_count",
                f"CAST(coalesce(sum(CASE WHEN {any_key_null} THEN _n END), 0) AS BIGINT) AS null_key_rows",
                "CAST(count_if(_n > 1) AS BIGINT) AS duplicate_key_groups"]
        cols += [f"CAST(coalesce(sum(\"null__{c}\"), 0) AS BIGINT) AS \"null__{c}\"" for c in null_cols]
        cols += [f"CAST(coalesce(sum(\"neg__{c}\"), 0) AS BIGINT) AS \"neg__{c}\"" for c in numeric]
        prof = (f"SELECT {', '.join(cols)} FROM (SELECT {inner} FROM {src} "
                f"GROUP BY {', '.join(keys)})")
    else:
        cols = ["CAST(count(*) AS BIGINT) AS row_count"]
        if keys:
            cols.append(f"CAST(count_if({any_key_null}) AS BIGINT) AS null_key_rows")
        cols += [f"CAST(count_if({c} IS NULL) AS BIGINT) AS \"null__{c}\"" for c in null_cols]
        cols += [f"CAST(count_if({c} < 0) AS BIGINT) AS \"neg__{c}\"" for c in numeric]
        prof = f"SELECT {', '.join(cols)} FROM {src}"

    def row(check, col, failed, expected, actual, violated):
        col_sql = "CAST(NULL AS VARCHAR)" if col is None else f"'{col}'"
        failed_sql = "CAST(NULL AS BIGINT)" if failed is None else f"CAST({failed} AS BIGINT)"
        return (f"SELECT '{stage}' AS stage, '{table_name}' AS table_name, '{check}' AS \"check\", "
                f"{col_sql} AS column_name, {failed_sql} AS failed_rows, "
                f"CAST({expected} AS BIGINT) AS expected, CAST({actual} AS BIGINT) AS actual, "
                f"({violated}) AS violated FROM prof_{table_name}")

    empty = "EMPTY_GOLD_DATASET" if stage == "gold" else "EMPTY_DATASET"
    rows = [row(empty, None, None, 1, "row_count", "row_count = 0")]
    if keys:
        kn = ",".join(keys)
        rows.append(row("NULL_PRIMARY_KEY", kn, "null_key_rows", 0, "null_key_rows", "null_key_rows > 0"))
        if duplicate_check:
            rows.append(row("DUPLICATE_PRIMARY_KEYS", kn, "duplicate_key_groups", 0,
                            "duplicate_key_groups", "duplicate_key_groups > 0"))
    for c in critical:
        n = f'"null__{c}"'
        rows.append(row("BUSINESS_RULE_VIOLATION", c, n, 0, n, f"{n} > 0"))
    if min_rows is not None:
        rows.append(row("LOW_ROW_COUNT", None, None, min_rows, "row_count", f"row_count < {min_rows}"))
    for c in metrics:
        n = f'"null__{c}"'
        rows.append(row("MISSING_BUSINESS_METRIC", c, n, 0, n, f"{n} > 0"))
    for c in numeric:
        n = f'"neg__{c}"'
        rows.append(row("NEGATIVE_BUSINESS_METRIC", c, n, 0, n, f"{n} > 0"))
    body = " UNION ALL ".join(rows)
    return (f"(SELECT stage, table_name, \"check\", column_name, failed_rows, expected, actual "
            f"FROM (WITH prof_{table_name} AS ({prof}) {body}) WHERE violated)")


_ITEM_KEYS = ("order_id", "item_seq")
_SILVER_ITEM_CHECKS = dict(keys=_ITEM_KEYS, critical=("order_id", "product_id", "quantity",
                                                       "unit_price"), stage="silver")
_GOLD_ITEM_CHECKS = dict(metrics=("quantity", "net_amount", "net_amount_inr"),
                         numeric=("quantity", "net_amount", "net_amount_inr"),
                         min_rows=10, stage="gold")

ORACLE.update({
    "dq_empty": "WITH li_future AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2100-01-01') "
                + findings_sql("li_future", "lineitem_future", stage="gold", metrics=("l_quantity",),
                               numeric=("l_quantity",), min_rows=10),
    "dq_min_rows": findings_sql("orders", "orders", stage="gold", metrics=("o_totalprice",),
                                numeric=("o_totalprice",), min_rows=1_000_000_000),
    "dq_null_key": f"WITH {SILVER_ORDER_ITEMS} "
                   + findings_sql("silver_items", "slv_order_items", keys=_ITEM_KEYS,
                                  duplicate_check=False),
    "dq_duplicate_keys": findings_sql("lineitem", "lineitem", keys=("l_orderkey", "l_linenumber")),
    "dq_critical_nulls": f"WITH {SILVER_ORDER_ITEMS} "
                         + findings_sql("silver_items", "slv_order_items",
                                        critical=("order_id", "product_id", "quantity", "unit_price",
                                                  "dt", "order_ts", "tax_amount", "discount_pct")),
    "dq_metric_nulls": f"WITH {GOLD_ORDER_ITEMS} "
                       + findings_sql("gold_items", "gld_fact_order_items", **_GOLD_ITEM_CHECKS),
    "dq_negative": findings_sql("customer", "customer", stage="gold", metrics=("c_acctbal", "c_name"),
                                numeric=("c_acctbal",), min_rows=5),
    "dq_report": f"WITH {GOLD_ORDER_ITEMS} "
                 + findings_sql("silver_items", "slv_order_items", **_SILVER_ITEM_CHECKS)
                 + " UNION ALL "
                 + findings_sql("gold_items", "gld_fact_order_items", **_GOLD_ITEM_CHECKS)
                 + " UNION ALL "
                 + findings_sql("orders", "orders", keys=("o_orderkey",),
                                critical=("o_custkey", "o_orderdate")),
    "bad_rows": f"WITH {SILVER_ORDER_ITEMS} SELECT * FROM silver_items "
                "WHERE order_id IS NULL OR item_seq IS NULL",
    "split_valid": f"WITH {SILVER_ORDER_ITEMS} SELECT * FROM silver_items "
                   "WHERE NOT (order_id IS NULL OR item_seq IS NULL)",
})
