"""CSV binding, layer names, catalog tables, stage evidence."""

import uuid

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tierlake.operators import incident
from tierlake.session import scratch_path
from tierlake.sources import events as ev
from tierlake.sources.ingest import ensure_layers, read_csv, table_name, with_audit, write_table

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType()),
                     StructField("qty", IntegerType())])


def _reordered_csv(spark):
    path = scratch_path(spark, "t_reordered")
    spark.createDataFrame([("a", "1", "7"), ("b", "2", "2.0"), ("c", "x", None)],
                          "name string, id string, qty string") \
        .write.option("header", True).csv(path)
    return path


def test_bind_by_position_swaps_columns(spark):
    rows = read_csv(spark, _reordered_csv(spark), SCHEMA).orderBy("name").collect()
    # header ignored: 'name' values land in id (not a number -> NULL)
    assert all(r.id is None for r in rows)


def test_bind_by_name(spark):
    df = read_csv(spark, _reordered_csv(spark), SCHEMA, bind="name")
    assert df.columns == ["id", "name", "qty"]
    assert {tuple(r) for r in df.collect()} == {(1, "a", 7), (2, "b", 2), (None, "c", None)}


def test_audit_columns(spark):
    df = with_audit(read_csv(spark, _reordered_csv(spark), SCHEMA, bind="name"), "file_name",
                    "ingest_timestamp", time_first=False)
    assert df.columns[-2:] == ["file_name", "ingest_timestamp"]
    assert df.where("file_name like '%.csv'").count() == 3


def test_table_names():
    assert table_name("brz_orders") == "bronze.brz_orders"
    assert table_name("slv_orders") == "silver.slv_orders"
    assert table_name("gld_fact_order_items") == "gold.gld_fact_order_items"
    assert table_name("gld_products", catalog="shop") == "shop.gold.products"
    assert table_name("slv_x", names={"slv_x": "slv_items"}) == "silver.slv_items"


def test_catalog_table_round_trip(spark):
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    root = scratch_path(spark, "t_wh")
    ensure_layers(spark, root, prefix=prefix)
    name = prefix + table_name("slv_items")
    write_table(spark.range(10), name, path=f"{root}/items")
    write_table(spark.range(3), name, path=f"{root}/items")  # full overwrite
    assert spark.table(name).count() == 3


def test_stage_context(spark):
    root = scratch_path(spark, "t_ctx")
    ev.append_events(spark, root, [
        ev.event("execution", "b", "run1", "a1", status="FAILED", row_count=0),
        ev.event("anomaly", "b", "run1", "a1", anomaly_type="PIPELINE_FAILURE"),
        ev.event("lineage", "b", "run1", "a1", upstream_tables=["x"], downstream_table="y"),
        ev.event("quarantine_record", "b", "run1", "a1", error_type="NULL_PRIMARY_KEY"),
        ev.event("execution", "b", "run2", "a2", status="SUCCESS", row_count=5),
    ])
    ctx = incident.stage_context(ev.read_events(spark, root), "run1").collect()
    assert sorted(r.event_type for r in ctx) == ["anomaly", "execution", "lineage"]
    summary = {r.stage_run_id: r for r in incident.stage_summary(ev.read_events(spark, root)).collect()}
    assert summary["run1"].n_execution == 1 and summary["run1"].n_anomaly == 1
    assert summary["run2"].n_lineage == 0


def test_table_rebuilt_from_its_own_path(spark):
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    root = scratch_path(spark, "t_wh")
    ensure_layers(spark, root, prefix=prefix)
    name, path = prefix + table_name("slv_rebuild"), f"{root}/rebuild"
    write_table(spark.range(4), name, path=path)
    write_table(spark.read.parquet(path).selectExpr("id * 10 AS id"), name, path=path)
    assert sorted(r.id for r in spark.table(name).collect()) == [0, 10, 20, 30]
