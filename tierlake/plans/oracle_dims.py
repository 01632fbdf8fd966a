"""DuckDB SQL for the dimension-mart queries (``plans.catalog_dims``)."""

from __future__ import annotations

from tierlake.plans.oracle import dec_text, strip, to_double, to_int


def _arr(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


COUNTRIES = ["India", "Australia", "United Kingdom", "United States",
             "United Arab Emirates", "Singapore", "Canada", "Germany"]
COUNTRY_CODES = ["IN", "AU", "GB", "US", "AE", "SG", "CA", "DE"]
STATES = ["KA", "MH", "NSW", "ENG", "CA", "DU", "SG", "ON", "XX", None, "TX", "UP"]


def initcap(e: str) -> str:
    return f"(upper(left({e}, 1)) || lower(substr({e}, 2)))"


def dedupe_sql(src: str, keys: list[str], order: list[str]) -> str:
    """Ordered de-duplication: first row per key, NULLs first in the order."""
    order_sql = ", ".join(f"{c} NULLS FIRST" for c in order) or "1"
    return (f"SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY "
            f"{', '.join(keys)} ORDER BY {order_sql}) AS _rn FROM {src}) WHERE _rn = 1")


# --------------------------------------------------------------------------
# Raw inputs
# --------------------------------------------------------------------------

RAW_BRANDS_FROM_PART = """
raw_brands AS (
  SELECT CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_brand || '*' ELSE p_brand END AS brand_code,
         CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_name || ' ' ELSE p_name END AS brand_name,
         CASE p_type WHEN 'PROMO' THEN 'GROCERY' WHEN 'ECONOMY' THEN 'BOOKS'
                     WHEN 'SMALL' THEN 'TOYS' ELSE p_type END AS category_code
  FROM part
)"""

RAW_CATEGORY_FROM_PART = """
raw_category AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS category_code,
         p_type || ' ' || p_name AS category_name
  FROM part
)"""

_PRICE = dec_text("p_retailprice", 2)
RAW_PRODUCTS_FROM_PART = f"""
raw_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         'SKU-' || CAST(p_partkey AS VARCHAR) AS sku,
         CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS category_code,
         lower(replace(p_brand, '#', '')) AS brand_code,
         split_part(p_name, ' ', 1) AS color,
         CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size,
         CASE p_partkey % 5 WHEN 0 THEN 'Coton' WHEN 1 THEN 'Alumium' WHEN 2 THEN 'Ruber'
                            WHEN 3 THEN 'Steel' ELSE NULL END AS material,
         CASE WHEN p_partkey % 11 = 0 THEN {dec_text('p_size', 1)} || 'kg'
              ELSE CAST(p_size * 10 AS VARCHAR) || 'g' END AS weight_grams,
         CASE WHEN p_partkey % 2 = 0 THEN replace({_PRICE}, '.', ',') ELSE {_PRICE} END AS length_cm,
         CAST(p_size AS FLOAT) AS width_cm,
         CASE WHEN p_partkey % 13 = 0 THEN CAST(NULL AS FLOAT) ELSE CAST(p_size * 2 AS FLOAT) END
           AS height_cm,
         CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN -p_size ELSE p_size END
           AS rating_count
  FROM part
)"""

RAW_PRODUCTS_FROM_SUPPLIER = f"""
raw_products AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS product_id,
         s_name AS sku,
         'r' || CAST(s_nationkey % 5 AS VARCHAR) AS category_code,
         CASE WHEN s_suppkey % 10 = 9 THEN 'n99' ELSE 'n' || CAST(s_nationkey AS VARCHAR) END
           AS brand_code,
         'black' AS color,
         'M' AS size,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Coton' ELSE 'Steel' END AS material,
         CAST(s_suppkey % 500 AS VARCHAR) || 'g' AS weight_grams,
         {dec_text('s_acctbal', 2)} AS length_cm,
         CAST(s_nationkey AS FLOAT) AS width_cm,
         CASE WHEN s_suppkey % 4 = 0 THEN CAST(NULL AS FLOAT) ELSE CAST(1.5 AS FLOAT) END AS height_cm,
         CAST(s_nationkey - 12 AS INTEGER) AS rating_count
  FROM supplier
)"""

RAW_BRANDS_FROM_NATION = """
raw_brands AS (
  SELECT 'N#' || CAST(n_nationkey AS VARCHAR) AS brand_code,
         n_name AS brand_name,
         CASE WHEN n_nationkey % 6 = 5 THEN 'R9' ELSE 'R' || CAST(n_regionkey AS VARCHAR) END
           AS category_code
  FROM nation
)"""

RAW_CATEGORY_FROM_REGION = """
raw_category AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS category_code, r_name AS category_name
  FROM region
)"""

RAW_CUSTOMERS = f"""
raw_customers AS (
  SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN c_custkey % 7 = 0 THEN NULL
              ELSE '+91-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
         ({_arr(COUNTRY_CODES)})[CAST(c_nationkey % 8 + 1 AS INTEGER)] AS country_code,
         ({_arr(COUNTRIES)})[CAST(c_nationkey % 8 + 1 AS INTEGER)] AS country,
         ({_arr(STATES)})[CAST(c_custkey % 12 + 1 AS INTEGER)] AS state
  FROM customer
)"""

RAW_CALENDAR = """
raw_calendar AS (
  SELECT strftime(o_orderdate, '%d-%m-%Y') AS date,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN o_orderkey % 2 = 0 THEN lower(dayname(o_orderdate))
              ELSE upper(dayname(o_orderdate)) END AS day_name,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(quarter(o_orderdate) AS INTEGER) END
           AS quarter,
         CAST(-weekofyear(o_orderdate) AS INTEGER) AS week_of_year
  FROM orders
)"""

# --------------------------------------------------------------------------
# Silver / gold steps (each a CTE reading the previous one)
# --------------------------------------------------------------------------

SILVER_BRANDS = f"""
silver_brands AS (
  SELECT {strip('brand_code', '[^A-Za-z0-9]')} AS brand_code,
         trim(brand_name) AS brand_name,
         CASE category_code WHEN 'GROCERY' THEN 'GRCY' WHEN 'BOOKS' THEN 'BKS'
                            WHEN 'TOYS' THEN 'TOY' ELSE category_code END AS category_code
  FROM raw_brands
)"""

SILVER_CATEGORY = f"""
silver_category AS (
  SELECT upper(category_code) AS category_code, category_name
  FROM ({dedupe_sql('raw_category', ['category_code'], ['category_name'])})
)"""

SILVER_PRODUCTS = f"""
silver_products AS (
  SELECT product_id, sku, upper(category_code) AS category_code, upper(brand_code) AS brand_code,
         color, size,
         CASE material WHEN 'Coton' THEN 'Cotton' WHEN 'Alumium' THEN 'Aluminum'
                       WHEN 'Ruber' THEN 'Rubber' ELSE material END AS material,
         {to_int(strip('weight_grams', 'g'))} AS weight_grams,
         CAST({to_double("replace(length_cm, ',', '.')")} AS FLOAT) AS length_cm,
         width_cm, height_cm,
         CASE WHEN rating_count IS NOT NULL THEN abs(rating_count) ELSE 0 END AS rating_count
  FROM raw_products
)"""

SILVER_CUSTOMERS = """
silver_customers AS (
  SELECT customer_id, coalesce(phone, 'Not Available') AS phone, country_code, country, state
  FROM raw_customers WHERE customer_id IS NOT NULL
)"""

_CAL = "(SELECT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, year, day_name, " \
       "quarter, week_of_year FROM raw_calendar)"
SILVER_DATE = f"""
silver_date AS (
  SELECT date, year, {initcap('day_name')} AS day_name,
         coalesce('Q' || CAST(quarter AS VARCHAR) || '-' || CAST(year AS VARCHAR), '') AS quarter,
         coalesce('Week' || CAST(abs(week_of_year) AS VARCHAR) || '-' || CAST(year AS VARCHAR), '')
           AS week
  FROM ({dedupe_sql(_CAL, ['date'], ['year', 'day_name', 'quarter', 'week_of_year'])})
)"""

GOLD_DATE = """
gold_date AS (
  SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_id, date, year,
         monthname(date) AS month_name, day_name,
         CASE WHEN day_name IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend,
         quarter, week
  FROM silver_date
)"""

GOLD_PRODUCTS = """
brand_category AS (
  SELECT b.brand_name, b.brand_code, c.category_name, c.category_code
  FROM silver_brands b JOIN silver_category c ON b.category_code = c.category_code
),
gold_products AS (
  SELECT p.product_id, p.sku, p.category_code,
         coalesce(bc.category_name, 'Not Available') AS category_name,
         p.brand_code, coalesce(bc.brand_name, 'Not Available') AS brand_name,
         p.color, p.size, p.material, p.weight_grams, p.length_cm, p.width_cm, p.height_cm,
         p.rating_count
  FROM silver_products p LEFT JOIN brand_category bc ON p.brand_code = bc.brand_code
)"""


def _region_rows() -> str:
    from tierlake.sources.lookups import STATE_REGIONS
    rows = [f"('{c}', '{s}', '{r}')" for c, states in STATE_REGIONS.items()
            for s, r in states.items()]
    return "region_map(country, state, region) AS (VALUES " + ", ".join(rows) + ")"


GOLD_CUSTOMERS = _region_rows() + """,
gold_customers AS (
  SELECT c.country, c.state, c.customer_id, c.phone, c.country_code,
         coalesce(m.region, 'Other') AS region
  FROM silver_customers c LEFT JOIN region_map m ON c.country = m.country AND c.state = m.state
)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


ORACLE_DIMS: dict[str, str] = {
    "code_clean": _w(RAW_BRANDS_FROM_PART, SILVER_BRANDS) + " SELECT * FROM silver_brands",
    "dim_upper_dedupe": _w(RAW_CATEGORY_FROM_PART, SILVER_CATEGORY) + " SELECT * FROM silver_category",
    "units_clean": _w(RAW_PRODUCTS_FROM_PART, SILVER_PRODUCTS) + " SELECT * FROM silver_products",
    "customer_defaults": _w(RAW_CUSTOMERS, SILVER_CUSTOMERS) + " SELECT * FROM silver_customers",
    "date_dim": _w(RAW_CALENDAR, SILVER_DATE, GOLD_DATE) + " SELECT * FROM gold_date",
    "product_dim": _w(RAW_BRANDS_FROM_NATION, SILVER_BRANDS, RAW_CATEGORY_FROM_REGION,
                      SILVER_CATEGORY, RAW_PRODUCTS_FROM_SUPPLIER, SILVER_PRODUCTS, GOLD_PRODUCTS)
                   + " SELECT * FROM gold_products",
    "region_lookup": _w(RAW_CUSTOMERS, SILVER_CUSTOMERS, GOLD_CUSTOMERS)
                     + " SELECT * FROM gold_customers",
    "dedupe_single": dedupe_sql("documents", ["text"], ["doc_id", "lang", "source", "n_chars"]),
    "dedupe_composite": dedupe_sql(
        "lineitem", ["l_orderkey", "l_linenumber"],
        ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]),
}
