"""Dimension-mart queries on the driver's tables.

Raw dimension inputs are deterministic projections of part, supplier,
nation, region, customer and orders (mirrored in ``plans.oracle_dims``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.operators.dedupe import dedupe
from tierlake.plans import marts
from tierlake.plans.catalog import _dec_text, _s, table

COUNTRIES = ["India", "Australia", "United Kingdom", "United States",
             "United Arab Emirates", "Singapore", "Canada", "Germany"]
COUNTRY_CODES = ["IN", "AU", "GB", "US", "AE", "SG", "CA", "DE"]
STATES = ["KA", "MH", "NSW", "ENG", "CA", "DU", "SG", "ON", "XX", None, "TX", "UP"]


def _pick(values: list, index: Column) -> Column:
    """values[index] (0-based) as a string column."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


# --------------------------------------------------------------------------
# Raw dimension inputs
# --------------------------------------------------------------------------

def raw_brands_from_part(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        F.when(k % 4 == 0, F.concat(F.lit(" "), "p_brand", F.lit("*")))
         .otherwise(F.col("p_brand")).alias("brand_code"),
        F.when(k % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
         .otherwise(F.col("p_name")).alias("brand_name"),
        F.when(F.col("p_type") == "PROMO", F.lit("GROCERY"))
         .when(F.col("p_type") == "ECONOMY", F.lit("BOOKS"))
         .when(F.col("p_type") == "SMALL", F.lit("TOYS"))
         .otherwise(F.col("p_type")).alias("category_code"),
    )


def raw_category_from_part(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        F.when(k % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("category_code"),
        F.concat_ws(" ", "p_type", "p_name").alias("category_name"),
    )


def raw_products_from_part(part: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    price = _dec_text(F.col("p_retailprice"), 2)
    return part.select(
        _s(k).alias("product_id"),
        F.concat(F.lit("SKU-"), _s(k)).alias("sku"),
        F.when(k % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("category_code"),
        F.lower(F.regexp_replace("p_brand", "#", "")).alias("brand_code"),
        F.element_at(F.split("p_name", " "), 1).alias("color"),
        F.when(size < 10, F.lit("S")).when(size < 30, F.lit("M")).otherwise(F.lit("L")).alias("size"),
        F.when(k % 5 == 0, F.lit("Coton")).when(k % 5 == 1, F.lit("Alumium"))
         .when(k % 5 == 2, F.lit("Ruber")).when(k % 5 == 3, F.lit("Steel"))
         .otherwise(F.lit(None).cast("string")).alias("material"),
        F.when(k % 11 == 0, F.concat(_dec_text(size, 1), F.lit("kg")))
         .otherwise(F.concat(_s(size * 10), F.lit("g"))).alias("weight_grams"),
        F.when(k % 2 == 0, F.regexp_replace(price, r"\.", ",")).otherwise(price).alias("length_cm"),
        size.cast("float").alias("width_cm"),
        F.when(k % 13 == 0, F.lit(None).cast("float"))
         .otherwise((size * 2).cast("float")).alias("height_cm"),
        F.when(k % 9 == 0, F.lit(None).cast("int"))
         .when(k % 4 == 0, -size).otherwise(size).alias("rating_count"),
    )


def raw_products_from_supplier(supplier: DataFrame) -> DataFrame:
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    return supplier.select(
        _s(k).alias("product_id"),
        F.col("s_name").alias("sku"),
        F.concat(F.lit("r"), _s(nk % 5)).alias("category_code"),
        F.when(k % 10 == 9, F.lit("n99")).otherwise(F.concat(F.lit("n"), _s(nk))).alias("brand_code"),
        F.lit("black").alias("color"),
        F.lit("M").alias("size"),
        F.when(k % 3 == 0, F.lit("Coton")).otherwise(F.lit("Steel")).alias("material"),
        F.concat(_s(k % 500), F.lit("g")).alias("weight_grams"),
        _dec_text(F.col("s_acctbal"), 2).alias("length_cm"),
        nk.cast("float").alias("width_cm"),
        F.when(k % 4 == 0, F.lit(None).cast("float")).otherwise(F.lit(1.5).cast("float")).alias("height_cm"),
        (nk - 12).cast("int").alias("rating_count"),
    )


def raw_brands_from_nation(nation: DataFrame) -> DataFrame:
    nk = F.col("n_nationkey")
    return nation.select(
        F.concat(F.lit("N#"), _s(nk)).alias("brand_code"),
        F.col("n_name").alias("brand_name"),
        F.when(nk % 6 == 5, F.lit("R9"))
         .otherwise(F.concat(F.lit("R"), _s(F.col("n_regionkey")))).alias("category_code"),
    )


def raw_category_from_region(region: DataFrame) -> DataFrame:
    return region.select(
        F.concat(F.lit("r"), _s(F.col("r_regionkey"))).alias("category_code"),
        F.col("r_name").alias("category_name"),
    )


def raw_customers(customer: DataFrame) -> DataFrame:
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    return customer.select(
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(_s(k)).alias("customer_id"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("+91-"), F.lpad(_s(k), 8, "0"))).alias("phone"),
        _pick(COUNTRY_CODES, nk % 8).alias("country_code"),
        _pick(COUNTRIES, nk % 8).alias("country"),
        _pick(STATES, k % 12).alias("state"),
    )


def raw_calendar(orders: DataFrame) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    day = F.date_format(d, "EEEE")
    return orders.select(
        F.date_format(d, "dd-MM-yyyy").alias("date"),
        F.year(d).alias("year"),
        F.when(k % 2 == 0, F.lower(day)).otherwise(F.upper(day)).alias("day_name"),
        F.when(k % 17 == 0, F.lit(None).cast("int")).otherwise(F.quarter(d)).alias("quarter"),
        (-F.weekofyear(d)).alias("week_of_year"),
    )


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------

def code_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: brand codes stripped to letters and digits, category codes fixed."""
    return marts.silver_brands(raw_brands_from_part(table(spark, sf_dir, "part")), audit=False)


def dim_upper_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: de-duplicate on the raw code, then upper-case (both cases survive)."""
    raw = raw_category_from_part(table(spark, sf_dir, "part"))
    return marts.silver_category(raw, order_by=[], audit=False)


def units_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: weights, lengths, codes, material spellings, rating counts."""
    return marts.silver_products(raw_products_from_part(table(spark, sf_dir, "part")), audit=False)


def customer_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: rows without an id dropped, missing phone marked."""
    return marts.silver_customers(raw_customers(table(spark, sf_dir, "customer")), audit=False)


def date_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 + M9: calendar from order dates, labels, month name, weekend flag."""
    silver = marts.silver_date(raw_calendar(table(spark, sf_dir, "orders")), order_by=[],
                               audit=False)
    return marts.gold_date(silver, audit=False)


def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: products (suppliers) with brand (nation) and category (region)."""
    brands = marts.silver_brands(raw_brands_from_nation(table(spark, sf_dir, "nation")), audit=False)
    category = marts.silver_category(raw_category_from_region(table(spark, sf_dir, "region")),
                                     order_by=[], audit=False)
    products = marts.silver_products(raw_products_from_supplier(table(spark, sf_dir, "supplier")),
                                     audit=False)
    return marts.gold_products(brands, category, products, audit=False)


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: customers with their sales region; unknown pairs give 'Other'."""
    silver = marts.silver_customers(raw_customers(table(spark, sf_dir, "customer")), audit=False)
    return marts.gold_customers(silver, audit=False)


def dedupe_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per exact text, the lowest doc_id kept."""
    return dedupe(table(spark, sf_dir, "documents"), ["text"], order_by=["doc_id"])


def dedupe_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineitem row per (l_orderkey, l_linenumber), total order."""
    return dedupe(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"],
                  order_by=[])


QUERIES = {
    "code_clean": code_clean,
    "dim_upper_dedupe": dim_upper_dedupe,
    "units_clean": units_clean,
    "customer_defaults": customer_defaults,
    "date_dim": date_dim,
    "product_dim": product_dim,
    "region_lookup": region_lookup,
    "dedupe_single": dedupe_single,
    "dedupe_composite": dedupe_composite,
}
