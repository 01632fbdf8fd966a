"""Queries for rules kept as data, loads that lose no row, keys across loads,
types counted by the load, join audits, nested schemas and kept incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from tierlake.operators import drift
from tierlake.operators.join_audit import join_profile
from tierlake.operators.rule_table import validate_table
from tierlake.plans import catalog_dims as D
from tierlake.plans import marts
from tierlake.plans.catalog import raw_order_items, table
from tierlake.plans.catalog_ops import RAW_ITEM_SCHEMA
from tierlake.session import scratch_path
from tierlake.sources import events as ev
from tierlake.sources.lattice import load_observed
from tierlake.sources.rescue import REASON, good_rows, load_rescued
from tierlake.streaming.incidents import current_incidents, keep_incidents
from tierlake.streaming.keystate import KeyState
from tierlake.streaming.landing import CSV_TEXT_OPTIONS, ingest_landing

# --------------------------------------------------------------------------
# Rules as data (V1, V2)
# --------------------------------------------------------------------------


def item_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on lineitem, several from each part and supplier, stored as a
    table: least and most quantities, sets of line numbers, flag patterns,
    dates; and some that can't be applied."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")

    def rule(source, key, name, column, kind, value):
        return source.select(
            F.concat(F.lit(f"{name}_"), F.col(key).cast("string")).alias("rule_id"),
            F.lit("lineitem").alias("table_name"), F.lit(column).alias("column_name"),
            F.lit(kind).alias("rule_type"), value.alias("value"),
            F.when(F.col(key) % 2 == 0, "WARN").otherwise("ERROR").alias("severity"))

    size, key = F.col("p_size"), F.col("s_suppkey")
    found = [
        rule(part, "p_partkey", "qty_min", "l_quantity", "min", size.cast("string")),
        rule(part, "p_partkey", "qty_max", "l_quantity", "max", size.cast("string")),
        rule(part, "p_partkey", "line_set", "l_linenumber", "in_set",
             F.to_json(F.sequence(F.lit(1), size % 9 + 1))),
        rule(supplier, "s_suppkey", "flag_fmt", "l_returnflag", "regex",
             F.when(key % 3 == 0, '"^[AN]$"').otherwise('"^[ANR]$"')),
        rule(supplier, "s_suppkey", "flag_set", "l_returnflag", "in_set",
             F.when(key % 2 == 0, '["A","R"]').otherwise('["R","N","A"]')),
        rule(supplier, "s_suppkey", "status_min", "l_linestatus", "min",
             F.when(key % 2 == 0, '"G"').otherwise('"F"')),
        rule(supplier, "s_suppkey", "ship_max", "l_shipdate", "max",
             F.concat(F.lit('"'), (key % 7 + 1994).cast("string"), F.lit('-06-30"'))),
        rule(supplier, "s_suppkey", "ship_nn", "l_shipdate", "not_null", F.lit(None).cast("string")),
        rule(supplier, "s_suppkey", "disc_nulls", "l_discount", "null_ratio", F.lit("0.01")),
        rule(supplier, "s_suppkey", "no_column", "l_comment", "not_null", F.lit(None).cast("string")),
        rule(supplier, "s_suppkey", "no_value", "l_tax", "min", F.lit('"cheap"')),
    ]
    path = scratch_path(spark, "rules")
    for one in found:
        one.write.mode("append").parquet(path)
    return spark.read.parquet(path)


RULED = ["l_quantity", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_tax"]


def rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 + V2: every rule of a stored table of rules, applied to lineitem."""
    return validate_table(table(spark, sf_dir, "lineitem"), item_rules(spark, sf_dir), columns=RULED)


# --------------------------------------------------------------------------
# Rows that don't fit their declared schema
# --------------------------------------------------------------------------

DECLARED_ORDER = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", IntegerType()),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
    StructField("o_orderdate", DateType())])


def rescued_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S10: orders landed as CSV lines, some with values of another
    type or with more or fewer fields; the rows that fit, and the others with
    the reason, as quarantined."""
    root = scratch_path(spark, "rescue")
    o = table(spark, sf_dir, "orders")
    way = F.pmod("o_orderkey", F.lit(20))
    price = F.format_string("%.2f", "o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = [F.col("o_orderkey").cast("string"),
              F.when(way.isin(1, 2), F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")),
              F.col("o_orderstatus"), F.when(way == 3, "").otherwise(price),
              F.when(way.isin(2, 4), "soon").otherwise(day)]
    line = F.concat_ws(",", *fields)
    line = F.when(way == 5, F.concat(line, F.lit(",more"))).when(
        way == 6, F.concat_ws(",", *fields[:2])).otherwise(line)
    o.select(line.alias("value")).write.text(f"{root}/raw")
    load_rescued(spark, f"{root}/raw", DECLARED_ORDER, f"{root}/bronze", f"{root}/telemetry", "batch", "run",
                 "orders", "bronze_orders", options={"header": "false"})
    good = good_rows(spark, f"{root}/bronze", DECLARED_ORDER).select(
        F.lit("fits").alias("reason"), F.lit("").alias("lost"), F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_totalprice").alias("price"))
    record = F.from_json("raw_record", f"{REASON} string, rescued_columns array<string>, rescued_line string")
    bad = ev.read_events(spark, f"{root}/telemetry", "quarantine_record").select(record.alias("r")).select(
        F.col(f"r.{REASON}").alias("reason"), F.coalesce(F.array_join("r.rescued_columns", ","), F.lit("")).alias("lost"),
        F.substring_index("r.rescued_line", ",", 1).alias("key"), F.lit(None).cast("double").alias("price"))
    return good.unionByName(bad)


# --------------------------------------------------------------------------
# Keys across loads (Q5)
# --------------------------------------------------------------------------

def landing_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 across loads: raw order items land in three drops; the keys that
    occurred more than once in all of them."""
    root = scratch_path(spark, "landing_keys")
    raw = raw_order_items(table(spark, sf_dir, "lineitem"))
    keys = KeyState(f"{root}/keys", StructType([StructField(c, StringType()) for c in ("order_id", "item_seq")]))
    for drop in range(3):
        (raw.where(F.col("product_id").cast("long") % 3 == drop).write.mode("append").option("header", True)
         .options(**CSV_TEXT_OPTIONS).option("nullValue", "\\N").csv(f"{root}/landing"))
        ingest_landing(spark, f"{root}/landing", RAW_ITEM_SCHEMA, f"{root}/bronze", f"{root}/ckpt",
                       null_value="\\N", key_state=keys, telemetry_root=f"{root}/telemetry")
    return keys.duplicates(spark)


# --------------------------------------------------------------------------
# Types counted by the load
# --------------------------------------------------------------------------

LANDED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def landed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + Q1: the schemas that the given tables have as CSV texts, counted
    by the loads' own writes."""
    rows = []
    for name in LANDED:
        root = scratch_path(spark, f"types_{name}")
        table(spark, sf_dir, name).write.option("header", True).csv(f"{root}/raw")
        found = load_observed(spark, f"{root}/raw", f"{root}/bronze")
        rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(found.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


# --------------------------------------------------------------------------
# Join audits
# --------------------------------------------------------------------------

def join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2: what the joins of the product mart and of some given tables
    do to their rows."""
    t = {n: table(spark, sf_dir, n) for n in ("nation", "region", "supplier", "orders", "lineitem", "customer", "part")}
    brands = marts.silver_brands(D.raw_brands_from_nation(t["nation"]), audit=False)
    category = marts.silver_category(D.raw_category_from_region(t["region"]), audit=False)
    products = D.raw_products_from_supplier(t["supplier"])
    audits = {
        "brands_category": join_profile(brands, category, ["category_code"]),
        "products_brands": join_profile(products, brands, ["brand_code"]),
        "orders_lineitem": join_profile(t["orders"], t["lineitem"], ["o_orderkey"], ["l_orderkey"]),
        "customer_orders": join_profile(t["customer"], t["orders"], ["c_custkey"], ["o_custkey"]),
        "part_lineitem": join_profile(t["part"], t["lineitem"], ["p_partkey"], ["l_partkey"]),
    }
    found = None
    for name, one in audits.items():
        one = one.select(F.lit(name).alias("join_name"), *[F.col(c).cast("bigint").alias(c) for c in one.columns])
        found = one if found is None else found.unionByName(one)
    return found


# --------------------------------------------------------------------------
# Nested schemas
# --------------------------------------------------------------------------

EVERY_TABLE = [*LANDED, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def catalog_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over the catalog: every given table lands as JSON lines, its row in
    a struct; the schemas that all lines have against the declared ones."""
    declared, found = {}, {}
    for name in EVERY_TABLE:
        nested = table(spark, sf_dir, name).select(F.struct("*").alias("record"))
        path = scratch_path(spark, f"json_{name}")
        # JSON repeats every name in every line: compressed, and in files that are read side by side.
        nested.write.option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).json(path)
        declared[name], found[name] = nested.schema, spark.read.json(path).schema
    return drift.nested_drift(drift.path_frame(spark, declared), drift.path_frame(spark, found)).select(
        "table_name", "column_name", "change", "expected_type", "actual_type")


ITEM_CONTRACT = (
    "item struct<orderkey: bigint, linenumber: int, note: string>, "
    "measures array<struct<amount: double, unit: string, name: string>>, rates map<string, decimal(10,4)>")


def nested_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 inside columns: line items as structs, arrays and maps of texts,
    some damaged, conformed to a contract of other types, order and fields."""
    li = table(spark, sf_dir, "lineitem")
    odd = F.col("l_orderkey") % 10 == 0
    item = F.struct(F.col("l_linenumber").cast("string").alias("linenumber"),
                    F.col("l_orderkey").cast("string").alias("orderkey"), F.lit("x").alias("extra"))

    def measure(name, value):
        text = F.when(odd, "n/a").otherwise(F.col(value).cast("string"))
        return F.struct(F.lit(name).alias("name"), text.alias("amount"))

    raw = li.select(F.when(F.col("l_linenumber") != 3, item).alias("item"),
                    F.array(measure("quantity", "l_quantity"), measure("price", "l_extendedprice")).alias("measures"),
                    F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount")).alias("rates"))
    done = drift.conform(raw, StructType.fromDDL(ITEM_CONTRACT), drift.EvolutionRules(allow_new_columns=False))
    return done.select("item.orderkey", "item.linenumber", "item.note", F.col("measures")[0]["name"].alias("first"),
                       F.col("measures")[0]["amount"].alias("quantity"), F.col("measures")[1]["amount"].alias("price"),
                       F.col("measures")[1]["unit"].alias("unit"),
                       (F.col("rates")["tax"] * 10000).cast("bigint").alias("tax_bp"),
                       (F.col("rates")["discount"] * 10000).cast("bigint").alias("discount_bp"))


# --------------------------------------------------------------------------
# Incidents kept up to date
# --------------------------------------------------------------------------

def incident_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 per user as events arrive: 'error' events as failures and 'signup'
    events as anomalies come in four drops, in no order of time."""
    root = scratch_path(spark, "incident_stream")
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    failed = F.col("event_type") == "error"
    rows = e.select(F.col("user_id").cast("string").alias("batch_id"),
                    F.lpad(F.col("event_id").cast("string"), 20, "0").alias("artifact_id"),
                    F.col("ts").cast("timestamp").alias("timestamp"), F.when(failed, "FAILED").alias("status"),
                    F.when(failed, "execution").otherwise("anomaly").alias("event_type"))
    for drop in range(4):
        ev.write_events(rows.where(F.pmod(F.crc32(F.col("artifact_id").cast("binary")), F.lit(4)) == drop),
                        f"{root}/telemetry")
        keep_incidents(spark, f"{root}/telemetry", f"{root}/incidents", f"{root}/ckpt")
    found = current_incidents(spark, f"{root}/incidents")
    return found.select(F.col("batch_id").cast("bigint").alias("user_id"), "incident_type",
                        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
                        F.col("artifact_id").cast("bigint").alias("event_id"))


QUERIES = {f.__name__: f for f in (rules_table, rescued_rows, landing_duplicates, landed_types, join_audit,
                                   catalog_drift, nested_conform, incident_stream)}
