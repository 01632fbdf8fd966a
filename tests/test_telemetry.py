"""Events, quarantine and the observed stage run (success and failure paths)."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tierlake.operators.quality import Checks
from tierlake.plans.stages import StageSpec, run_layers, run_stage
from tierlake.session import scratch_path
from tierlake.sources import events as ev
from tierlake.sources.ingest import read_csv, with_audit


def test_events_round_trip_and_missing(spark):
    root = scratch_path(spark, "t_events")
    assert ev.read_events(spark, root, "anomaly").count() == 0
    ev.append_events(spark, root, [
        ev.event("anomaly", "b", "r", "a", pipeline_name="p", stage_name="silver",
                 anomaly_type="NULL_PRIMARY_KEY", details={"failed_rows": 3}),
        ev.event("lineage", "b", "r", "a", upstream_tables=["x", "y"], downstream_table="z",
                 operation="op"),
    ])
    an = ev.read_events(spark, root, "anomaly").first()
    assert an.anomaly_type == "NULL_PRIMARY_KEY" and '"failed_rows": 3' in an.details
    assert ev.read_events(spark, root, "lineage").first().upstream_tables == ["x", "y"]
    with open(f"{root}/event_type=anomaly/broken.json", "w") as fh:
        fh.write("{not json\n")
    assert ev.read_events(spark, root, "anomaly").count() == 1
    report = ev.unreadable_events(spark, root).collect()
    assert len(report) == 1 and report[0].file_path.endswith("broken.json")
    assert report[0].line == "{not json" and report[0].reason == "not JSON"


def test_kept_and_reported_are_all_lines(spark):
    root = scratch_path(spark, "t_bad")
    stamp = '"timestamp":"2025-08-01T09:00:00.000000"'
    lines = [f'{{"artifact_id":"good",{stamp}}}', f'{{"artifact_id":"n","row_count":"abc",{stamp}}}',
             '{"artifact_id":"t","timestamp":"yesterday"}', '{"artifact_id":"none"}', '{"cut', "  "]
    spark.createDataFrame([(x, "execution") for x in lines], "value string, event_type string") \
        .write.partitionBy("event_type").text(root)
    evs = ev.read_events(spark, root)
    # the same rows whatever is selected
    assert evs.count() == 1
    for cols in (["artifact_id"], ["row_count"], ["timestamp"], evs.columns):
        assert len(evs.select(*cols).collect()) == 1
    bad = ev.unreadable_events(spark, root)
    assert sorted(r.reason for r in bad.collect()) == ["bad value", "bad value", "no timestamp",
                                                       "not JSON"]
    assert bad.count() == 4


def test_one_append_is_one_file_per_kind(spark):
    root = scratch_path(spark, "t_files")
    ev.append_events(spark, root, [ev.event("anomaly", "b", "r", str(i)) for i in range(20)])
    files = [r[0] for r in ev.read_events(spark, root).select(F.lit(1)).collect()]
    assert len(files) == 20
    assert spark.read.text(root).select("_metadata.file_path").distinct().count() == 1


def test_latest_over_stored_events_with_maps(spark):
    from tierlake.operators import incident
    root = scratch_path(spark, "t_latest")
    ev.append_events(spark, root, [
        ev.event("execution", "b", "r1", "a1", status="FAILED"),
        ev.event("execution", "b", "r2", "a2", status="FAILED"),
        ev.event("schema_drift", "b", "r2", "a2", expected_schema={"x": "int"})])
    evs = ev.read_events(spark, root)
    assert incident.latest_failure(evs).first().stage_run_id == "r2"
    assert incident.latest_failure(evs, by=["batch_id"]).first().artifact_id == "a2"
    from tierlake.operators.dedupe import dedupe
    assert dedupe(evs, ["batch_id"], order_by=[]).count() == 1  # maps sort by their text


def test_diagnose_uses_evidence_of_its_own_batch(spark):
    from tierlake.__main__ import diagnose
    root = scratch_path(spark, "t_diag")
    t0 = dt.datetime(2025, 1, 1)

    def lin(batch, art, at, table, ups):
        return ev.event("lineage", batch, "r", art, t0 + dt.timedelta(seconds=at),
                        downstream_table=table, upstream_tables=ups)
    ev.append_events(spark, root, [
        lin("old", "o1", 0, "bronze.t", ["raw"]), ev.event("schema_drift", "old", "r", "o1", t0),
        ev.event("anomaly", "old", "r", "o1", t0),
        lin("new", "n1", 10, "bronze.t", ["raw"]), lin("new", "n2", 11, "silver.t", ["bronze.t"]),
        ev.event("execution", "new", "r", "n2", t0 + dt.timedelta(seconds=12), status="FAILED")])
    report = diagnose(spark, root)
    assert report["incident"]["table"] == "silver.t"
    assert [(c["node"], c["severity"], c["rank"]) for c in report["root_causes"]] == \
        [("silver.t", 3, 1)]


def test_unknown_event_field():
    with pytest.raises(ValueError):
        ev.event("anomaly", "b", "r", "a", not_a_field=1)


SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def _raw(spark):
    path = scratch_path(spark, "t_raw")
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], SCHEMA) \
        .write.option("header", True).csv(path)
    return path


def test_bronze_stage_success(spark):
    raw = _raw(spark)
    tel = scratch_path(spark, "t_tel")
    spec = StageSpec("bronze_t", "bronze.t", scratch_path(spark, "t_tbl"),
                     lambda: with_audit(read_csv(spark, raw, SCHEMA)), [raw],
                     Checks(keys=("id",), stage="bronze"), source_path=raw, expected_schema=SCHEMA)
    res = run_stage(spark, spec, tel, "batch", "run")
    assert res["status"] == "SUCCESS" and res["row_count"] == 4
    checks = {f["check"] for f in res["findings"]}
    assert checks == {"NULL_PRIMARY_KEY", "DUPLICATE_PRIMARY_KEYS"}
    q = ev.read_events(spark, tel, "quarantine_record").collect()
    assert len(q) == 1 and '"name":"c"' in q[0].raw_record
    drift = ev.read_events(spark, tel, "schema_drift").collect()
    assert len(drift) == 1 and drift[0].type_changes["id"]["actual"] == "int"
    ex = ev.read_events(spark, tel, "execution").first()
    assert ex.status == "SUCCESS" and ex.row_count == 4


def test_failure_path_order_and_reraise(spark):
    tel = scratch_path(spark, "t_tel")

    def broken():
        return spark.range(3).select("no_such_column")

    spec = StageSpec("gold_t", "gold.t", scratch_path(spark, "t_tbl"), broken, ["silver.t"],
                     Checks(stage="gold"))
    with pytest.raises(Exception) as info:
        run_stage(spark, spec, tel, "batch", "run")
    assert "no_such_column" in str(info.value)
    evs = ev.read_events(spark, tel).orderBy("timestamp").collect()
    assert [e.event_type for e in evs] == ["anomaly", "execution", "lineage"]
    assert evs[0].anomaly_type == "PIPELINE_FAILURE"
    assert evs[1].status == "FAILED" and evs[1].row_count == 0


def test_layers_stop_at_first_failure(spark):
    tel = scratch_path(spark, "t_tel")
    out = scratch_path(spark, "t_tbl")
    ok = StageSpec("silver_ok", "silver.ok", f"{out}/ok", lambda: spark.range(20), ["bronze.x"],
                   Checks(keys=("id",)))
    bad = StageSpec("gold_bad", "gold.bad", f"{out}/bad", lambda: spark.range(1).select("nope"),
                    ["silver.ok"], Checks(stage="gold"))
    never = StageSpec("gold_never", "gold.never", f"{out}/never", lambda: spark.range(1),
                      ["silver.ok"], Checks(stage="gold"))
    batch = str(uuid.uuid4())
    with pytest.raises(Exception):
        run_layers(spark, {"silver": [ok], "gold": [bad, never]}, tel, batch)
    ex = {r.pipeline_name: r.status for r in ev.read_events(spark, tel, "execution").collect()}
    assert ex == {"silver_ok": "SUCCESS", "gold_bad": "FAILED"}


def test_rules_ride_in_the_check_pass(spark):
    from tierlake.operators.rules import Rule
    tel = scratch_path(spark, "t_tel")
    df_rules = [Rule("id_min", "id", "min", 1, table_name="t"),
                Rule("name_set", "name", "in_set", ["a", "b"], "WARN", "t"),
                Rule("name_nn", "name", "not_null", table_name="t")]
    spec = StageSpec("silver_t", "silver.t", scratch_path(spark, "t_tbl"),
                     lambda: spark.createDataFrame([(0, "a"), (1, "b"), (1, "z"), (2, None)],
                                                   "id long, name string"),
                     ["bronze.t"], Checks(keys=("id",)), rules=df_rules)
    run_stage(spark, spec, tel, "batch", "run")
    got = {r.validation_type: (r.status, r.failed_rows)
           for r in ev.read_events(spark, tel, "validation").collect()}
    assert got == {"min": ("FAILED", 1), "in_set": ("FAILED", 1), "not_null": ("FAILED", 1)}


def test_compact_events(spark):
    src, dst = scratch_path(spark, "t_ev_src"), scratch_path(spark, "t_ev_dst")
    for i in range(5):
        ev.append_events(spark, src, [ev.event("lineage", "b", f"r{i}", "a", downstream_table="t",
                                               upstream_tables=["u"]),
                                      ev.event("execution", "b", f"r{i}", "a", status="SUCCESS")])
    assert ev.compact_events(spark, src, dst) == 10
    back = ev.read_events(spark, dst)
    assert back.count() == 10 and back.where("event_type = 'lineage'").count() == 5
    import glob
    local = dst.replace("file:", "")
    assert len(glob.glob(f"{local}/event_type=lineage/*.json")) == 1


def test_stage_may_rebuild_the_table_it_reads(spark):
    tel = scratch_path(spark, "t_tel")
    path = scratch_path(spark, "t_self")
    spark.range(5).write.parquet(path)
    spec = StageSpec("silver_self", "silver.self", path,
                     lambda: spark.read.parquet(path).withColumn("x", F.lit(1)), ["silver.self"],
                     Checks())
    assert run_stage(spark, spec, tel, "batch", "run")["row_count"] == 5
    back = spark.read.parquet(path)
    assert back.count() == 5 and "x" in back.columns


def test_failed_write_keeps_old_table(spark):
    tel = scratch_path(spark, "t_tel")
    path = scratch_path(spark, "t_keep")
    spark.range(7).write.parquet(path)

    def build():
        return spark.range(3).select(F.raise_error(F.lit("boom")).alias("id"))

    spec = StageSpec("silver_keep", "silver.keep", path, build, ["x"], Checks())
    with pytest.raises(Exception):
        run_stage(spark, spec, tel, "batch", "run")
    assert spark.read.parquet(path).count() == 7  # the old table is whole


def test_quarantine_keeps_every_bad_row(spark):
    root = scratch_path(spark, "t_q")
    df = spark.range(100).select(F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id"))
                                 .alias("k"), "id")
    ev.quarantine(df.where(F.col("k").isNull()), root, "b", "r", "a", "p", "src.csv")
    assert ev.read_events(spark, root, "quarantine_record").count() == 25  # no 10-row cap


def test_import_one_file_per_event_layout(spark, tmp_path):
    import json as _json

    def put(folder, name, doc):
        d = tmp_path / folder
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(_json.dumps(doc, indent=4) if isinstance(doc, dict) else doc)

    base = {"batch_id": "b1", "stage_run_id": "r1", "artifact_id": "a1"}
    put("logs/execution", "1.json", {**base, "event_type": "execution",
                                     "timestamp": "2025-08-01 10:00:00.123456",
                                     "pipeline_name": "p", "stage_name": "silver",
                                     "status": "FAILED", "execution_time_sec": 1.5,
                                     "row_count": 0, "retry_count": 0})
    put("logs/anomalies", "2.json", {**base, "event_type": "anomaly",
                                     "timestamp": "2025-08-01 09:59:59.000001",
                                     "pipeline_name": "p", "stage_name": "silver",
                                     "anomaly_type": "PIPELINE_FAILURE",
                                     "details": {"error": "boom", "failed_rows": 3}})
    put("logs/schema", "3.json", {**base, "event_type": "schema_drift",
                                  "timestamp": "2025-08-01 09:00:00.000000",
                                  "expected_schema": {"a": "IntegerType()"},
                                  "actual_schema": {"a": "StringType()"},
                                  "missing_columns": [], "extra_columns": ["x"],
                                  "type_changes": {"a": {"expected": "IntegerType()",
                                                         "actual": "StringType()"}}})
    put("logs/lineage", "4.json", {**base, "event_type": "lineage",
                                   "timestamp": "2025-08-01 10:00:00.200000",
                                   "upstream_tables": ["bronze.t"], "downstream_table": "silver.t",
                                   "operation": "bronze_to_silver_transformation"})
    put("quarantine", "5.json", {**base, "event_type": "quarantine_record",
                                 "timestamp": "2025-08-01 08:00:00.000000", "source_file": "f.csv",
                                 "error_type": "NULL_PRIMARY_KEY", "raw_record": {"id": None, "n": "x"},
                                 "repair_attempted": False, "repair_status": "NOT_ATTEMPTED"})
    put("logs/lineage", "broken.json", "{not json")
    put("logs/lineage", "6.json", {**base, "timestamp": "some day"})
    lost = {r.file_path.rsplit("/", 1)[1]: r.reason
            for r in ev.unreadable_legacy_events(spark, str(tmp_path)).collect()}
    assert lost == {"broken.json": "not JSON", "6.json": "bad value"}
    dst = scratch_path(spark, "t_legacy")
    assert ev.import_legacy_events(spark, str(tmp_path), dst) == 5
    evs = {r.event_type: r for r in ev.read_events(spark, dst).collect()}
    assert set(evs) == {"execution", "anomaly", "schema_drift", "lineage", "quarantine_record"}
    assert evs["execution"].status == "FAILED" and evs["execution"].timestamp.microsecond == 123456
    assert _json.loads(evs["anomaly"].details)["failed_rows"] == 3
    assert evs["schema_drift"].type_changes["a"]["actual"] == "StringType()"
    assert evs["lineage"].upstream_tables == ["bronze.t"]
    assert _json.loads(evs["quarantine_record"].raw_record)["n"] == "x"
    from tierlake.operators import incident
    fail = ev.read_events(spark, dst, "execution").where("status = 'FAILED'")
    got = incident.find_incident(fail, ev.read_events(spark, dst, "anomaly"))
    assert got["incident_type"] == "failure"  # strictly newer than the anomaly
