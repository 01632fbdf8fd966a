"""Queries for sources/sinks, drift, observed runs, incidents and rules.

File round trips write under the session's shared scratch folder
(``spark.checkpoint.dir``), a new folder per call.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, FloatType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

from tierlake.operators import incident
from tierlake.operators.dedupe import dedupe
from tierlake.operators.drift import EvolutionRules, conform, schema_diff_df
from tierlake.operators.quality import Checks
from tierlake.operators.rules import Rule, validate
from tierlake.plans import catalog_dims as D
from tierlake.plans.catalog import fact_clean, raw_order_items, table
from tierlake.plans.catalog_dims import raw_customers
from tierlake.plans.medallion import dimension_layers
from tierlake.plans.stages import StageSpec, run_layers
from tierlake.session import scratch_path
from tierlake.sources import events as ev
from tierlake.sources.ingest import (ensure_layers, infer_schema, read_csv, table_name,
                                     with_audit, write_table)
from tierlake.streaming.landing import CSV_TEXT_OPTIONS, ingest_landing

# --------------------------------------------------------------------------
# Sources and sinks
# --------------------------------------------------------------------------

CUSTOMER_SCHEMA = StructType([
    StructField("c_custkey", LongType()), StructField("c_name", StringType()),
    StructField("c_nationkey", IntegerType()), StructField("c_acctbal", DoubleType()),
    StructField("c_mktsegment", StringType()),
])


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S3: customer written as CSV, scanned back with a declared schema
    and audit columns (the ingest time is left out of the result)."""
    path = scratch_path(spark, "csv_customer")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    df = with_audit(read_csv(spark, path, CUSTOMER_SCHEMA), "_source_file", "_ingested_at")
    return df.select(*CUSTOMER_SCHEMA.fieldNames(),
                     F.col("_source_file").endswith(".csv").alias("from_csv"))


def json_events_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S9: events appended as JSON lines partitioned by kind, read back
    with a declared schema (microsecond timestamps kept)."""
    path = scratch_path(spark, "json_events")
    events = table(spark, sf_dir, "events")
    (events.write.mode("append").partitionBy("event_type")
     .options(**ev.TS_OPTIONS).json(path))
    schema = StructType([f for f in events.schema.fields if f.name != "event_type"]
                        + [StructField("event_type", StringType())])
    return spark.read.schema(schema).options(**ev.TS_OPTIONS).json(path)


def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S6 + S7: part stored as a layer-qualified table, scanned back."""
    prefix = f"tl{uuid.uuid4().hex[:10]}_"
    root = scratch_path(spark, "warehouse")
    ensure_layers(spark, root, prefix=prefix)
    name = prefix + table_name("brz_part")
    write_table(table(spark, sf_dir, "part"), name, path=f"{root}/{name}")
    return spark.table(name)


def quarantine_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer row with a NULL key quarantined as JSON events
    (from the executors), then read back and parsed."""
    root = scratch_path(spark, "telemetry")
    raw = raw_customers(table(spark, sf_dir, "customer"))
    ev.quarantine(raw.where(F.col("customer_id").isNull()), root, "batch", "run", "artifact",
                  "bronze_customers", "customers.csv")
    back = ev.read_events(spark, root, "quarantine_record")
    rec = F.from_json("raw_record", raw.schema)
    return back.select("error_type", "repair_status", rec.alias("r")).select(
        "error_type", "repair_status", "r.*")


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 + S2: supplier landed as CSV with an extra column; discovery
    inference compared with the declared schema (one row per change)."""
    path = scratch_path(spark, "csv_supplier")
    sup = table(spark, sf_dir, "supplier")
    (sup.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal",
                F.concat(F.lit("note "), "s_name").alias("s_comment"))
     .write.option("header", True).csv(path))
    declared = StructType([
        StructField("s_suppkey", IntegerType()), StructField("s_name", StringType()),
        StructField("s_nationkey", IntegerType()), StructField("s_acctbal", FloatType()),
        StructField("s_phone", StringType()),
    ])
    return schema_diff_df(spark, declared, infer_schema(spark, path))


def schema_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: supplier with a mistyped key, a missing and an extra column,
    conformed to its contract (extra dropped, missing NULL, key cast)."""
    sup = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name", "s_acctbal",
        F.concat(F.lit("x"), "s_name").alias("s_extra"))
    contract = StructType([
        StructField("s_suppkey", LongType()), StructField("s_name", StringType()),
        StructField("s_nationkey", IntegerType()), StructField("s_acctbal", DoubleType()),
    ])
    return conform(sup, contract, EvolutionRules(allow_new_columns=False))


RAW_ITEM_SCHEMA = StructType([StructField(c, StringType()) for c in (
    "dt", "order_ts", "customer_id", "order_id", "item_seq", "product_id", "quantity",
    "unit_price_currency", "unit_price", "discount_pct", "tax_amount", "channel", "coupon_code")])


def landing_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 incremental: raw order items land as CSV files (two drops); an
    availableNow file stream loads each drop into bronze exactly once."""
    root = scratch_path(spark, "landing")
    raw = raw_order_items(table(spark, sf_dir, "lineitem"))
    first = F.col("order_id").cast("long") % 2 == 0
    args = (spark, f"{root}/landing", RAW_ITEM_SCHEMA, f"{root}/bronze", f"{root}/ckpt")
    for part in (raw.where(first), raw.where(~first)):  # two drops, together the whole table
        (part.write.mode("append").option("header", True).options(**CSV_TEXT_OPTIONS)
         .option("nullValue", "\\N").csv(f"{root}/landing"))
        ingest_landing(*args, max_files_per_trigger=4, null_value="\\N")  # only the new drop
    ingest_landing(*args, null_value="\\N")  # nothing new: no batch, no duplicate rows
    return spark.read.parquet(f"{root}/bronze").select(*RAW_ITEM_SCHEMA.fieldNames())


# --------------------------------------------------------------------------
# Observed staged run
# --------------------------------------------------------------------------

ORDERS_SCHEMA = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
    StructField("o_orderdate", TimestampType()), StructField("o_orderpriority", StringType()),
])


SILVER_ORDER_RULES = [
    Rule("o_price_min", "o_totalprice", "min", 0.0, table_name="silver.orders"),
    Rule("o_status_set", "o_orderstatus", "in_set", ["O", "F"], "WARN", "silver.orders"),
    Rule("o_prio_fmt", "o_orderpriority", "regex", r"^[1-5]-[A-Z ]+$", table_name="silver.orders"),
]


def observed_run(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Bronze (CSV -> table), silver (dedupe + clean), gold (two marts, the
    second one broken). Returns (telemetry_root, batch_id)."""
    root = scratch_path(spark, "run")
    raw = f"{root}/raw/orders"
    telemetry = f"{root}/telemetry"
    table(spark, sf_dir, "orders").write.option("header", True).csv(raw)
    brz, slv, gld = (f"{root}/bronze/orders", f"{root}/silver/orders", f"{root}/gold/orders")

    def silver():
        b = spark.read.parquet(brz).drop("_ingested_at", "_source_file")
        return dedupe(b, ["o_orderkey"], order_by=[]).withColumn(
            "o_orderpriority", F.trim(F.col("o_orderpriority")))

    def gold():
        s = spark.read.parquet(slv)
        return s.select("o_orderkey", "o_custkey", "o_totalprice",
                        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_id"),
                        F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0)
                        .alias("is_urgent"))

    def broken_gold():
        return spark.read.parquet(slv).select("o_orderkey", "o_shippriority")

    layers = {
        "bronze": [StageSpec("bronze_orders", "bronze.orders", brz,
                             lambda: with_audit(read_csv(spark, raw, ORDERS_SCHEMA)),
                             [raw], Checks(keys=("o_orderkey",), stage="bronze"),
                             source_path=raw, expected_schema=ORDERS_SCHEMA)],
        "silver": [StageSpec("silver_orders", "silver.orders", slv, silver, ["bronze.orders"],
                             Checks(keys=("o_orderkey",), critical=("o_custkey", "o_orderdate"),
                                    stage="silver"), rules=SILVER_ORDER_RULES)],
        "gold": [StageSpec("gold_orders", "gold.orders", gld, gold, ["silver.orders"],
                           Checks(metrics=("o_totalprice", "date_id"), min_rows=10, stage="gold")),
                 StageSpec("gold_order_priority", "gold.order_priority", f"{root}/gold/prio",
                           broken_gold, ["silver.orders"], Checks(min_rows=10, stage="gold"))],
    }
    batch_id = str(uuid.uuid4())
    try:
        run_layers(spark, layers, telemetry, batch_id)
    except AnalysisException as exc:  # the broken mart is part of the scenario
        if "o_shippriority" not in str(exc):
            raise
    return telemetry, batch_id


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 + Q11: execution events of an observed run (one per table)."""
    telemetry, batch_id = observed_run(spark, sf_dir)
    ex = ev.read_events(spark, telemetry, "execution").where(F.col("batch_id") == batch_id)
    return ex.select("stage_name", "pipeline_name", "status", "row_count")


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11 + M12: orders, customers and their mart as one batch. The silver
    stage fails twice and works at its second retry; the mart lacks its
    customers and fails for good. Resumed after that, the batch only runs the
    mart, and a third time nothing. One row per attempt."""
    root = scratch_path(spark, "resume")
    telemetry, broken = f"{root}/telemetry", [2]

    def silver():
        orders = spark.read.parquet(f"{root}/bronze/orders")
        if broken[0]:
            broken[0] -= 1
            return orders.select("o_no_such_column")
        return dedupe(orders, ["o_orderkey"], order_by=[])

    def mart(customers: str):
        return lambda: spark.read.parquet(f"{root}/silver/orders").groupBy("o_custkey").agg(
            F.count("*").alias("orders")).join(
            spark.read.parquet(customers).select(F.col("c_custkey").alias("o_custkey")), "o_custkey")

    def layers(customers: str) -> dict[str, list[StageSpec]]:
        return {
            "bronze": [StageSpec("bronze_orders", "bronze.orders", f"{root}/bronze/orders",
                                 lambda: table(spark, sf_dir, "orders"), ["orders"],
                                 Checks(stage="bronze")),
                       StageSpec("bronze_customers", "bronze.customers", f"{root}/bronze/customers",
                                 lambda: table(spark, sf_dir, "customer"), ["customer"],
                                 Checks(stage="bronze"))],
            "silver": [StageSpec("silver_orders", "silver.orders", f"{root}/silver/orders", silver,
                                 ["bronze.orders"], Checks(keys=("o_orderkey",), stage="silver"))],
            "gold": [StageSpec("gold_customers", "gold.customers", f"{root}/gold/customers",
                               mart(customers), ["silver.orders", "bronze.customers"],
                               Checks(keys=("o_custkey",), stage="gold"))],
        }

    batch_id = str(uuid.uuid4())
    try:
        run_layers(spark, layers(f"{root}/missing"), telemetry, batch_id, retries=2)
    except AnalysisException as exc:  # the missing input is part of the scenario
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    for _ in range(2):
        run_layers(spark, layers(f"{root}/bronze/customers"), telemetry, batch_id, retries=2, resume=True)
    ex = ev.read_events(spark, telemetry, "execution").where(F.col("batch_id") == batch_id)
    return ex.select("stage_name", "pipeline_name", "status", "retry_count", "row_count")


def dims_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11-M12 on the dimension pipeline: raw CSVs projected from nation,
    region, supplier, customer and orders go through bronze, silver and gold
    with their checks; one execution row per table."""
    root = scratch_path(spark, "dims_run")
    sources = {
        "brands": D.raw_brands_from_nation(table(spark, sf_dir, "nation")),
        "category": D.raw_category_from_region(table(spark, sf_dir, "region")),
        "products": D.raw_products_from_supplier(table(spark, sf_dir, "supplier")),
        "customers": D.raw_customers(table(spark, sf_dir, "customer")),
        "date": D.raw_calendar(table(spark, sf_dir, "orders")),
    }
    raw = {}
    for name, df in sources.items():
        raw[name] = f"{root}/raw/{name}"
        df.write.option("header", True).options(**CSV_TEXT_OPTIONS).csv(raw[name])
    batch_id = str(uuid.uuid4())
    run_layers(spark, dimension_layers(spark, raw, f"{root}/tables"), f"{root}/telemetry",
               batch_id)
    ex = ev.read_events(spark, f"{root}/telemetry", "execution") \
        .where(F.col("batch_id") == batch_id)
    return ex.select("pipeline_name", "stage_name", "status", "row_count")


def validation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V2 + S8: rule results of the silver stage, recorded as validation
    events in the same check pass as the keyed checks."""
    telemetry, batch_id = observed_run(spark, sf_dir)
    va = ev.read_events(spark, telemetry, "validation").where(F.col("batch_id") == batch_id)
    return va.select(F.get_json_object("details", "$.rule_id").alias("rule_id"),
                     "validation_type", "status", "failed_rows")


def lineage_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: lineage events of an observed run (raw path shown by name)."""
    telemetry, batch_id = observed_run(spark, sf_dir)
    li = ev.read_events(spark, telemetry, "lineage").where(F.col("batch_id") == batch_id)
    up = F.transform("upstream_tables", lambda u: F.regexp_replace(u, r"^.*/raw/", "raw/"))
    return li.select("downstream_table", "operation", F.array_join(up, ",").alias("upstream"))


def incident_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 -> R6 -> R7 on real telemetry: the observed run's incident (the
    broken gold mart), its upstream tables within the batch, and every
    table with evidence, ranked (most upstream first)."""
    telemetry, _ = observed_run(spark, sf_dir)
    return _diagnosed(ev.read_events(spark, telemetry)).drop("batch_id")


def _diagnosed(evs: DataFrame) -> DataFrame:
    evidence = incident.events_with_table(evs)
    return incident.diagnose(evs, evidence, incident.batch_incidents(evidence)).select(
        "batch_id", "incident_type", "incident_table", "node", "depth", "severity", "rank")


def doc_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored telemetry of one batch per language, a stage run per document:
    lineage to document ``id div 2``, a failed execution for toxic documents,
    an anomaly for those of quality 0, and drift, outside English, for ids
    divisible by 7. The time is the id in seconds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality"), "doc_id")
    doc = F.col("doc_id").cast("string")
    parent = F.when(F.col("doc_id") > 0, F.array(F.expr("doc_id div 2").cast("string"))) \
              .otherwise(F.array().cast("array<string>"))
    base = docs.select(
        F.col("lang").alias("batch_id"), doc.alias("stage_run_id"), doc.alias("artifact_id"),
        F.timestamp_seconds("doc_id").alias("timestamp"), doc.alias("downstream_table"),
        parent.alias("upstream_tables"),
        F.when(F.col("toxic") == 1, "FAILED").otherwise("SUCCESS").alias("status"),
        F.explode(F.array_compact(F.array(
            F.lit("lineage"), F.lit("execution"),
            F.when(F.col("quality") == 0, F.lit("anomaly")),
            F.when((F.col("lang") != "en") & (F.col("doc_id") % 7 == 0),
                   F.lit("schema_drift"))))).alias("event_type"))
    own = {"downstream_table": "lineage", "upstream_tables": "lineage", "status": "execution"}
    evs = base.select(*[F.when(F.col("event_type") == own[c], F.col(c)).alias(c) if c in own
                        else F.col(c) for c in base.columns])
    root = scratch_path(spark, "doc_telemetry")
    ev.write_events(evs, root)
    return ev.read_events(spark, root)


def diagnose_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R3, R6, R7 over the stored events of several batches, drift being
    evidence only in the batch that recorded it."""
    return _diagnosed(doc_telemetry(spark, sf_dir))


def stage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence events of the stage run behind the newest incident."""
    evs = doc_telemetry(spark, sf_dir)
    run = incident.batch_incidents(incident.events_with_table(evs), by=()).first()["stage_run_id"]
    return incident.stage_context(evs, run).select(
        "batch_id", "stage_run_id", "event_type", "status", "downstream_table")


def telemetry_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of the events table, some cut short, some with a value
    or a timestamp that does not parse or with none; kept lines and those
    reported, by reason."""
    e = table(spark, sf_dir, "events").where(F.col("event_id").isNotNull())
    way = F.col("event_id") % 10
    stamp = F.when(way == 2, F.lit("not a time")) \
             .when(way != 3, F.lit("2024-01-01T00:00:00.000000"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("artifact_id"),
                              F.when(way == 1, F.lit("abc")).alias("row_count"),
                              stamp.alias("timestamp")))
    root = scratch_path(spark, "damaged")
    (e.select(F.when(way == 0, F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line)
              .alias("value"), F.lit("lineage").alias("event_type"))
     .write.partitionBy("event_type").text(root))
    kept = ev.read_events(spark, root).select(F.lit("kept").alias("reason"))
    lost = ev.unreadable_events(spark, root).select("reason")
    return kept.unionByName(lost).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


# --------------------------------------------------------------------------
# Incident analysis on the events table
# --------------------------------------------------------------------------

def _events(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


def latest_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 per user: the newest 'error' event."""
    out = incident.latest(_events(spark, sf_dir, "error"), ts="ts", by=["user_id"])
    return out.select("user_id", "ts", "event_id", "value")


def latest_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 per user: the newest 'signup' event."""
    out = incident.latest(_events(spark, sf_dir, "signup"), ts="ts", by=["user_id"])
    return out.select("user_id", "ts", "event_id", "value")


def incident_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 per user: failure ('error') only when strictly newer than the
    anomaly ('signup'); ties go to the anomaly."""
    return incident.incident_choice(_events(spark, sf_dir, "error"),
                                    _events(spark, sf_dir, "signup"),
                                    by=["user_id"], ts="ts", cols=["event_id"])


def stage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4/A5 with users as runs: per run, events per kind, first/last ts."""
    return incident.stage_summary(table(spark, sf_dir, "events"), run="user_id",
                                  kinds=("view", "signup", "purchase", "error", "click"), ts="ts")


# --------------------------------------------------------------------------
# Lineage over documents: each doc derives from doc_id div 2
# --------------------------------------------------------------------------

def doc_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    up = F.when(F.col("doc_id") > 0, F.array(F.expr("doc_id div 2").cast("string"))) \
          .otherwise(F.array().cast("array<string>"))
    return d.select(F.col("lang").alias("batch_id"), F.col("source").alias("stage_run_id"),
                    F.col("doc_id").cast("string").alias("artifact_id"),
                    F.col("doc_id").cast("string").alias("downstream_table"),
                    up.alias("upstream_tables"), F.lit("derive").alias("operation"))


def _incident_docs(spark, sf_dir):
    return table(spark, sf_dir, "labels").where(F.col("quality") == 0).select("doc_id")


def incident_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each low-quality doc (the incident) with its lineage record."""
    inc = _incident_docs(spark, sf_dir).select(
        "doc_id", F.col("doc_id").cast("string").alias("artifact_id"))
    out = incident.lineage_record(inc, doc_lineage(spark, sf_dir), keys=["artifact_id"])
    return out.select("doc_id", "downstream_table", "operation",
                      F.array_join("upstream_tables", ",").alias("upstream"))


def direct_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 + J6: lineage records (same batch) producing each incident's input."""
    lin = doc_lineage(spark, sf_dir)
    inc = lin.join(_incident_docs(spark, sf_dir).select(F.col("doc_id").cast("string")
                                                       .alias("artifact_id")),
                   "artifact_id", "left_semi")
    out = incident.direct_upstream(inc, lin, table_col="downstream_table")
    return out.select("batch_id", "child", "parent", "stage_run_id", "artifact_id", "operation")


def _doc_edges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") > 0)
    return d.select(F.col("doc_id").alias("child"), F.expr("doc_id div 2").alias("parent"))


def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor of the incident docs, least depth."""
    starts = _incident_docs(spark, sf_dir).select(F.col("doc_id").alias("node"))
    return incident.lineage_closure(_doc_edges(spark, sf_dir), starts)


def root_cause_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per incident doc, the most upstream ancestor with evidence
    (toxic -> failure, low quality -> anomaly)."""
    starts = _incident_docs(spark, sf_dir).select(F.col("doc_id").alias("start"),
                                                 F.col("doc_id").alias("node"))
    closure = incident.lineage_closure(_doc_edges(spark, sf_dir), starts, group=["start"])
    lab = table(spark, sf_dir, "labels")
    evidence = lab.select(F.col("doc_id").alias("node"), incident.evidence_severity(
        F.col("toxic") == 1, F.col("quality") == 0, F.lit(False)).alias("severity"))
    return incident.rank_root_causes(closure, evidence, group=["start"], top=1)


# --------------------------------------------------------------------------
# Rules (V1-V3)
# --------------------------------------------------------------------------

def rules_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(table(spark, sf_dir, "lineitem"), [
        Rule("li_ship_nn", "l_shipdate", "not_null", table_name="lineitem"),
        Rule("li_qty_min", "l_quantity", "min", 1.0, table_name="lineitem"),
        Rule("li_disc_max", "l_discount", "max", 0.08, "WARN", "lineitem"),
        Rule("li_flag_set", "l_returnflag", "in_set", ["R", "A"], table_name="lineitem"),
        Rule("li_tax_min", "l_tax", "min", 0.0, table_name="lineitem"),
    ])


def rules_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(table(spark, sf_dir, "customer"), [
        Rule("cu_name_fmt", "c_name", "regex", r"^Customer#\d{9}$", table_name="customer"),
        Rule("cu_seg_fmt", "c_mktsegment", "regex", r"^[A-Z]+$", table_name="customer"),
        Rule("cu_name_low", "c_name", "regex", r"^Customer#0000000[0-4]", "WARN", "customer"),
    ])


def rules_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(table(spark, sf_dir, "lineitem"), [
        Rule("li_price_z", "l_extendedprice", "zscore", 2.0, table_name="lineitem"),
        Rule("li_qty_z", "l_quantity", "zscore", 1.5, "WARN", "lineitem"),
    ])


def rules_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(fact_clean(spark, sf_dir), [
        Rule("oi_qty_nulls", "quantity", "null_ratio", 0.01, table_name="slv_order_items"),
        Rule("oi_price_nulls", "unit_price", "null_ratio", 0.5, table_name="slv_order_items"),
        Rule("oi_tax_nulls", "tax_amount", "null_ratio", 0.02, table_name="slv_order_items"),
        Rule("oi_dt_nulls", "dt", "null_ratio", 0.1, table_name="slv_order_items"),
    ])


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "json_events_round_trip": json_events_round_trip,
    "catalog_round_trip": catalog_round_trip,
    "quarantine_round_trip": quarantine_round_trip,
    "schema_drift": schema_drift,
    "schema_conform": schema_conform,
    "landing_ingest": landing_ingest,
    "run_status": run_status,
    "resumed_run": resumed_run,
    "lineage_capture": lineage_capture,
    "validation_events": validation_events,
    "dims_run": dims_run,
    "incident_origin": incident_origin,
    "diagnose_batches": diagnose_batches,
    "stage_evidence": stage_evidence,
    "telemetry_damage": telemetry_damage,
    "latest_failure": latest_failure,
    "latest_anomaly": latest_anomaly,
    "incident_choice": incident_choice,
    "stage_context": stage_context,
    "incident_lineage": incident_lineage,
    "direct_upstream": direct_upstream,
    "lineage_closure": lineage_closure,
    "root_cause_rank": root_cause_rank,
    "rules_basic": rules_basic,
    "rules_regex": rules_regex,
    "rules_zscore": rules_zscore,
    "rules_null_ratio": rules_null_ratio,
}
