"""Incremental landing ingest: new files only, exactly once, checks per batch."""

import datetime as dt
import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from tierlake.operators import incident
from tierlake.operators.quality import Checks
from tierlake.session import scratch_path
from tierlake.sources import events as ev
from tierlake.streaming.incidents import current_incidents, keep_incidents
from tierlake.streaming.landing import CSV_TEXT_OPTIONS, ingest_landing

SCHEMA = StructType([StructField("order_id", StringType()), StructField("item_seq", StringType()),
                     StructField("coupon_code", StringType())])


def test_landing_incremental_exactly_once(spark):
    root = scratch_path(spark, "t_landing")
    land, out, ckpt, tel = f"{root}/in", f"{root}/bronze", f"{root}/ckpt", f"{root}/tel"
    checks = Checks(keys=("order_id", "item_seq"), stage="bronze")

    def drop(rows):
        (spark.createDataFrame(rows, SCHEMA).write.mode("append").option("header", True)
         .options(**CSV_TEXT_OPTIONS).csv(land))

    drop([("o1", "1", " A "), ("o1", "1", None), ("o2", None, "")])
    assert ingest_landing(spark, land, SCHEMA, out, ckpt, checks, tel) >= 1
    assert spark.read.parquet(out).count() == 3
    assert ingest_landing(spark, land, SCHEMA, out, ckpt, checks, tel) == 0  # nothing new
    drop([("o3", "1", "B")])
    assert ingest_landing(spark, land, SCHEMA, out, ckpt, checks, tel) == 1
    back = spark.read.parquet(out)
    assert back.count() == 4
    assert {"file_name", "ingest_timestamp", "batch_id"} <= set(back.columns)
    assert back.where("coupon_code = ' A '").count() == 1  # spaces kept
    found = {r.anomaly_type for r in ev.read_events(spark, tel, "anomaly").collect()}
    assert found == {"NULL_PRIMARY_KEY", "DUPLICATE_PRIMARY_KEYS"}


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_incidents_equal_the_choice_over_all_events(spark, seed):
    """Any order and split of the events, ties, repeated events, a group with
    most of them, groups with one kind only, damaged lines."""
    rng = random.Random(seed)
    root = scratch_path(spark, "t_incidents")
    tel, out, ckpt = f"{root}/tel", f"{root}/out", f"{root}/ckpt"
    assert current_incidents(spark, out).count() == 0
    rows = []
    for i in range(120):
        batch = rng.choice(["hot"] * 6 + ["b", "c", "d", None])
        kind = "anomaly" if batch == "c" else rng.choice(["execution", "anomaly", "lineage"])
        rows.append(ev.event(kind, batch, f"r{rng.randrange(4)}", f"t{rng.randrange(3)}",
                             dt.datetime(2024, 1, 1, 0, rng.randrange(8)),
                             **({"status": rng.choice(["FAILED", "SUCCESS"])} if kind == "execution" else {})))
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    spark.createDataFrame([("{not json", "anomaly")], "value string, event_type string").write.partitionBy(
        "event_type").mode("append").text(tel)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        ev.append_events(spark, tel, rows[lo:hi])
        assert keep_incidents(spark, tel, out, ckpt, max_files_per_trigger=2) >= 1
        assert keep_incidents(spark, tel, out, ckpt) == 0
        seen = ev.read_events(spark, tel)
        want = incident.incident_choice(
            incident.latest_failure(seen.where("event_type = 'execution'"), by=["batch_id"]),
            incident.latest_anomaly(seen.where("event_type = 'anomaly'"), by=["batch_id"]),
            by=["batch_id"], cols=["stage_run_id", "artifact_id"])
        got = current_incidents(spark, out)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
