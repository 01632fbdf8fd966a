"""Retries inside a run and batches that go on where they stopped."""

import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tierlake.operators.quality import Checks
from tierlake.plans.stages import StageSpec, run_layers, run_stage, table_states
from tierlake.session import scratch_path, scratch_root
from tierlake.sources import events as ev


class Flaky:
    """Builds ``df``, but fails the first ``times`` times."""

    def __init__(self, df, times=0):
        self.df, self.times, self.built = df, times, 0

    def __call__(self):
        self.built += 1
        if self.built <= self.times:
            raise RuntimeError(f"attempt {self.built}")
        return self.df


def spec(root, name, layer, build, upstream=()):
    return StageSpec(name, f"{layer}.{name}", f"{root}/{name}", build, list(upstream), Checks(stage=layer))


def executions(spark, root):
    rows = ev.read_events(spark, root, "execution").orderBy("timestamp").collect()
    return [(r.pipeline_name, r.status, r.retry_count, r.row_count) for r in rows]


def test_stage_fails_twice_then_works(spark):
    root = scratch_path(spark, "t_retry")
    build = Flaky(spark.range(7), 2)
    res = run_stage(spark, spec(root, "a", "silver", build), f"{root}/tel", "b", "r", retries=3)
    assert res["status"] == "SUCCESS" and build.built == 3 and spark.read.parquet(f"{root}/a").count() == 7
    assert executions(spark, f"{root}/tel") == [
        ("a", "RETRYING", 0, 0), ("a", "RETRYING", 1, 0), ("a", "SUCCESS", 2, 7)]
    tried = ev.read_events(spark, f"{root}/tel", "execution").where("status = 'RETRYING'")
    assert sorted("attempt" in r.details for r in tried.collect()) == [True, True]
    # no failure was left over to be investigated, and one lineage record
    assert ev.read_events(spark, f"{root}/tel", "anomaly").count() == 0
    assert ev.read_events(spark, f"{root}/tel", "lineage").count() == 1


def test_retries_run_out(spark):
    root = scratch_path(spark, "t_out")
    build = Flaky(spark.range(7), 5)
    with pytest.raises(RuntimeError, match="attempt 3"):
        run_stage(spark, spec(root, "a", "silver", build), f"{root}/tel", "b", "r", retries=2)
    assert [e[1:3] for e in executions(spark, f"{root}/tel")] == [("RETRYING", 0), ("RETRYING", 1), ("FAILED", 2)]
    assert ev.read_events(spark, f"{root}/tel", "anomaly").count() == 1


def test_resume_runs_only_what_is_missing(spark):
    root, batch = scratch_path(spark, "t_resume"), str(uuid.uuid4())
    a, b = Flaky(spark.range(3)), Flaky(spark.range(4))
    c, d = Flaky(spark.range(5), 1), Flaky(spark.range(6))
    layers = {"bronze": [spec(root, "a", "bronze", a), spec(root, "b", "bronze", b)],
              "silver": [spec(root, "c", "silver", c, ["bronze.a"]), spec(root, "d", "silver", d, ["bronze.b"])]}
    with pytest.raises(RuntimeError):
        run_layers(spark, layers, f"{root}/tel", batch)
    files = {n: sorted(spark.read.parquet(f"{root}/{n}").inputFiles()) for n in "ab"}
    runs = run_layers(spark, layers, f"{root}/tel", batch, resume=True)
    assert set(runs) == {"silver"} and (a.built, b.built, c.built, d.built) == (1, 1, 2, 1)
    assert files == {n: sorted(spark.read.parquet(f"{root}/{n}").inputFiles()) for n in "ab"}
    assert run_layers(spark, layers, f"{root}/tel", batch, resume=True) == {}
    # another batch starts from the beginning; without resume, so does the same one
    run_layers(spark, layers, f"{root}/tel", "other", resume=True)
    run_layers(spark, layers, f"{root}/tel", batch)
    assert (a.built, d.built) == (3, 3)
    with pytest.raises(ValueError):
        run_layers(spark, layers, f"{root}/tel", resume=True)


def test_resume_rebuilds_what_is_stale(spark):
    root, batch = scratch_path(spark, "t_stale"), str(uuid.uuid4())
    a, c, other = Flaky(spark.range(3)), Flaky(spark.range(5)), Flaky(spark.range(2))
    layers = {"bronze": [spec(root, "a", "bronze", a), spec(root, "o", "bronze", other)],
              "silver": [spec(root, "c", "silver", c, ["bronze.a"])]}
    run_layers(spark, layers, f"{root}/tel", batch)
    # the table that silver reads is loaded once more: silver is older than it
    run_layers(spark, {"bronze": layers["bronze"][:1]}, f"{root}/tel", batch)
    run_layers(spark, layers, f"{root}/tel", batch, resume=True)
    assert (a.built, c.built, other.built) == (2, 2, 1)
    # a later failure takes a table's success back, and with it what reads the table
    a.times = a.built + 1
    with pytest.raises(RuntimeError):
        run_layers(spark, {"bronze": layers["bronze"][:1]}, f"{root}/tel", batch)
    states = {r.downstream_table: r.status for r in table_states(ev.read_events(spark, f"{root}/tel"), batch).collect()}
    assert states == {"bronze.a": "FAILED", "bronze.o": "SUCCESS", "silver.c": "SUCCESS"}
    run_layers(spark, layers, f"{root}/tel", batch, resume=True)
    assert (a.built, c.built, other.built) == (4, 3, 1)


def test_resume_without_telemetry(spark):
    root = scratch_path(spark, "t_none")
    a = Flaky(spark.range(3))
    assert set(run_layers(spark, {"bronze": [spec(root, "a", "bronze", a)]}, f"{root}/tel", "b", resume=True)) == {"bronze"}
    assert table_states(ev.read_events(spark, f"{root}/none"), "b").count() == 0
    assert ev.read_events(spark, f"{root}/tel", "execution").select(F.max("retry_count")).first()[0] == 0


def test_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf={}, sparkContext=context)

    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_root(session(master))
        assert scratch_root(session(master, "hdfs://x/ckpt/")) == "hdfs://x/ckpt"
