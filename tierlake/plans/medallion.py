"""The e-commerce dimension and fact layers, ready for ``run_layers``.

``dimension_layers`` and ``fact_layers`` return ``{layer: [StageSpec]}``:
bronze loads CSV with the declared schemas and audit columns, silver and
gold build the marts from the stored tables of the layer below, and every
table carries its check configuration. Table files go under ``root`` (a
shared folder); lineage uses layer-qualified names.

    layers = dimension_layers(spark, {"brands": ".../brands/*.csv", ...}, root)
    run_layers(spark, layers, f"{root}/telemetry", batch_id)
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql.types import (FloatType, IntegerType, StringType, StructField, StructType)

from tierlake.operators.quality import Checks
from tierlake.plans import marts
from tierlake.plans.stages import StageSpec
from tierlake.sources.ingest import read_csv, table_name, with_audit

_S = StringType()


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


# Declared schemas of the raw sources (column, type, nullable).
BRANDS_SCHEMA = _schema(("brand_code", _S, False), ("brand_name", _S, True),
                        ("category_code", _S, True))
CATEGORY_SCHEMA = _schema(("category_code", _S, False), ("category_name", _S, True))
PRODUCTS_SCHEMA = _schema(
    ("product_id", _S, False), ("sku", _S, True), ("category_code", _S, True),
    ("brand_code", _S, True), ("color", _S, True), ("size", _S, True), ("material", _S, True),
    ("weight_grams", _S, True), ("length_cm", _S, True), ("width_cm", FloatType(), True),
    ("height_cm", FloatType(), True), ("rating_count", IntegerType(), True))
CUSTOMERS_SCHEMA = _schema(("customer_id", _S, False), ("phone", _S, True),
                           ("country_code", _S, True), ("country", _S, True), ("state", _S, True))
DATE_SCHEMA = _schema(("date", _S, True), ("year", IntegerType(), True), ("day_name", _S, True),
                      ("quarter", IntegerType(), True), ("week_of_year", IntegerType(), True))
ORDER_ITEMS_SCHEMA = _schema(*[(c, _S, True) for c in (
    "dt", "order_ts", "customer_id", "order_id", "item_seq", "product_id", "quantity",
    "unit_price_currency", "unit_price", "discount_pct", "tax_amount", "channel", "coupon_code")])

# Per-table checks (keys; critical or metric columns; minimum rows).
DIM_SOURCES = {
    # source: (bronze key, schema, key, (file column, time column, time first))
    "brands": ("brz_brands", BRANDS_SCHEMA, ("brand_code",), ("_source_file", "ingested_at", False)),
    "category": ("brz_category", CATEGORY_SCHEMA, ("category_code",),
                 ("_source_file", "_ingested_at", True)),
    "products": ("brz_products", PRODUCTS_SCHEMA, ("product_id",),
                 ("_source_file", "_ingested_at", True)),
    "customers": ("brz_customers", CUSTOMERS_SCHEMA, ("customer_id",),
                  ("_source_file", "_ingested_at", True)),
    "date": ("brz_calendar", DATE_SCHEMA, ("date",), ("_source_file", "_ingested_at", True)),
}
SILVER_CHECKS = {
    "slv_brands": Checks(keys=("brand_code",), critical=("brand_code", "brand_name")),
    "slv_category": Checks(keys=("category_code",), critical=("category_code", "category_name")),
    "slv_products": Checks(keys=("product_id",), critical=("product_id", "sku", "category_code")),
    "slv_customers": Checks(keys=("customer_id",), critical=("customer_id", "country")),
    "slv_date": Checks(keys=("date",), critical=("date", "year", "quarter")),
    "slv_fact_order_items": Checks(keys=("order_id", "item_seq"),
                                   critical=("order_id", "product_id", "quantity", "unit_price")),
}
GOLD_CHECKS = {
    "gld_products": Checks(metrics=("length_cm", "width_cm", "height_cm", "weight_grams"),
                           min_rows=10, stage="gold"),
    "gld_customers": Checks(metrics=("customer_id",), min_rows=5, stage="gold"),
    "gld_date": Checks(metrics=("date_id", "is_weekend"), min_rows=10, stage="gold"),
    "gld_fact_order_items": Checks(metrics=("quantity", "net_amount", "net_amount_inr"),
                                   min_rows=10, stage="gold"),
}


class _Tables:
    """Logical names and storage paths of the layer tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, catalog: str | None, fmt: str):
        self.spark, self.root, self.catalog, self.fmt = spark, root.rstrip("/"), catalog, fmt

    def name(self, key: str) -> str:
        return table_name(key, self.catalog)

    def path(self, key: str) -> str:
        return f"{self.root}/{self.name(key).replace('.', '/')}"

    def read(self, key: str):
        return self.spark.read.format(self.fmt).load(self.path(key))


def _bronze(t: _Tables, key: str, raw: str, schema: StructType, keys: tuple,
            audit: tuple, delimiter: str) -> StageSpec:
    file_col, time_col, time_first = audit
    return StageSpec(
        key, t.name(key), t.path(key),
        lambda: with_audit(read_csv(t.spark, raw, schema, delimiter), file_col, time_col,
                           time_first),
        [raw], Checks(keys=keys, stage="bronze", duplicate_check=False),
        source_path=raw, expected_schema=schema, delimiter=delimiter, fmt=t.fmt)


def _stage(t: _Tables, key: str, build, upstream: list[str], checks: Checks) -> StageSpec:
    return StageSpec(key, t.name(key), t.path(key), build, [t.name(u) for u in upstream],
                     checks, fmt=t.fmt)


def dimension_layers(spark: SparkSession, raw: Mapping[str, str], root: str,
                     catalog: str | None = None, fmt: str = "parquet",
                     delimiter: str = ",") -> dict[str, list[StageSpec]]:
    """Brands, category, products, customers and calendar through three
    layers. ``raw`` maps each source name to its CSV path or glob."""
    t = _Tables(spark, root, catalog, fmt)
    bronze = [_bronze(t, key, raw[src], schema, keys, audit, delimiter)
              for src, (key, schema, keys, audit) in DIM_SOURCES.items()]
    silver = [
        _stage(t, "slv_brands", lambda: marts.silver_brands(t.read("brz_brands")),
               ["brz_brands"], SILVER_CHECKS["slv_brands"]),
        _stage(t, "slv_category", lambda: marts.silver_category(t.read("brz_category")),
               ["brz_category"], SILVER_CHECKS["slv_category"]),
        _stage(t, "slv_products", lambda: marts.silver_products(t.read("brz_products")),
               ["brz_products"], SILVER_CHECKS["slv_products"]),
        _stage(t, "slv_customers", lambda: marts.silver_customers(t.read("brz_customers")),
               ["brz_customers"], SILVER_CHECKS["slv_customers"]),
        _stage(t, "slv_date", lambda: marts.silver_date(t.read("brz_calendar")),
               ["brz_calendar"], SILVER_CHECKS["slv_date"]),
    ]
    gold = [
        _stage(t, "gld_products",
               lambda: marts.gold_products(t.read("slv_brands"), t.read("slv_category"),
                                           t.read("slv_products")),
               ["slv_brands", "slv_category", "slv_products"], GOLD_CHECKS["gld_products"]),
        _stage(t, "gld_customers", lambda: marts.gold_customers(t.read("slv_customers")),
               ["slv_customers"], GOLD_CHECKS["gld_customers"]),
        _stage(t, "gld_date", lambda: marts.gold_date(t.read("slv_date")),
               ["slv_date"], GOLD_CHECKS["gld_date"]),
    ]
    return {"bronze": bronze, "silver": silver, "gold": gold}


def fact_layers(spark: SparkSession, raw_order_items: str, root: str,
                catalog: str | None = None, fmt: str = "parquet",
                delimiter: str = ",") -> dict[str, list[StageSpec]]:
    """Order items through three layers (CSV -> cleaned -> fact with INR)."""
    t = _Tables(spark, root, catalog, fmt)
    bronze = [_bronze(t, "brz_order_items", raw_order_items, ORDER_ITEMS_SCHEMA,
                      ("order_id", "item_seq"), ("file_name", "ingest_timestamp", False),
                      delimiter)]
    silver = [_stage(t, "slv_fact_order_items",
                     lambda: marts.silver_order_items(t.read("brz_order_items")),
                     ["brz_order_items"], SILVER_CHECKS["slv_fact_order_items"])]
    gold = [_stage(t, "gld_fact_order_items",
                   lambda: marts.gold_order_items(t.read("slv_fact_order_items")),
                   ["slv_fact_order_items"], GOLD_CHECKS["gld_fact_order_items"])]
    return {"bronze": bronze, "silver": silver, "gold": gold}
