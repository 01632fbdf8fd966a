"""Incident choice rules, closure against a plain BFS, ranking."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tierlake.operators import incident

T0 = dt.datetime(2025, 1, 1)


def frames(spark, failures, anomalies):
    schema = "run string, ts timestamp, id string"
    return spark.createDataFrame(failures, schema), spark.createDataFrame(anomalies, schema)


def test_incident_choice_rules(spark):
    f, a = frames(spark,
                  [("r1", T0, "f1"), ("r2", T0 + dt.timedelta(seconds=5), "f2"), ("r3", T0, "f3")],
                  [("r1", T0, "a1"), ("r2", T0, "a2"), ("r4", T0, "a4")])
    got = {r.run: (r.incident_type, r.id) for r in
           incident.incident_choice(f, a, by=["run"], ts="ts", cols=["id"]).collect()}
    assert got == {"r1": ("anomaly", "a1"),    # tie goes to the anomaly
                   "r2": ("failure", "f2"),    # strictly later failure wins
                   "r3": ("failure", "f3"),    # only a failure
                   "r4": ("anomaly", "a4")}    # only an anomaly


def test_no_incident(spark):
    f, a = frames(spark, [], [])
    assert incident.incident_choice(f, a, ts="ts", cols=["id"]).count() == 0


def test_latest_overall(spark):
    df = spark.createDataFrame([(T0, "x", "FAILED"), (T0 + dt.timedelta(1), "y", "FAILED"),
                                (T0 + dt.timedelta(2), "z", "SUCCESS")],
                               "timestamp timestamp, id string, status string")
    assert incident.latest_failure(df).first().id == "y"


def bfs(edges, starts, max_depth):
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    best = {}
    for s in starts:
        best.setdefault(s, 0)
    q = deque((s, 0) for s in starts)
    while q:
        n, d = q.popleft()
        if d >= max_depth:
            continue
        for p in parents.get(n, ()):
            if p not in best or best[p] > d + 1:
                best[p] = d + 1
                q.append((p, d + 1))
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_matches_bfs(spark, seed):
    rnd = random.Random(seed)
    n = 40
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(70)}  # cycles, diamonds
    starts = rnd.sample(range(n), 4)
    e = spark.createDataFrame(sorted(edges), "child long, parent long")
    s = spark.createDataFrame([(x,) for x in starts], "node long")
    got = {r.node: r.depth for r in incident.lineage_closure(e, s, max_depth=6).collect()}
    assert got == bfs(edges, starts, 6)


def test_closure_per_group(spark):
    e = spark.createDataFrame([("b1", "gold", "silver"), ("b1", "silver", "bronze"),
                               ("b2", "silver", "other")], "batch_id string, child string, parent string")
    s = spark.createDataFrame([("b1", "gold"), ("b2", "silver")], "batch_id string, node string")
    got = sorted(tuple(r) for r in incident.lineage_closure(e, s, group=["batch_id"]).collect())
    assert got == [("b1", "bronze", 2), ("b1", "gold", 0), ("b1", "silver", 1),
                   ("b2", "other", 1), ("b2", "silver", 0)]


def test_rank_root_causes(spark):
    closure = spark.createDataFrame([("gold", 0), ("silver", 1), ("bronze", 2), ("raw", 3)],
                                    "node string, depth int")
    evidence = spark.createDataFrame([("gold", 2), ("silver", 3), ("bronze", 1), ("raw", None)],
                                     "node string, severity int")
    ranked = sorted(incident.rank_root_causes(closure, evidence).collect(), key=lambda r: r["rank"])
    assert [r.node for r in ranked] == ["bronze", "silver", "gold"]


def test_find_incident_and_missing_lineage(spark):
    schema = "batch_id string, stage_run_id string, artifact_id string, timestamp timestamp"
    fail = spark.createDataFrame([("b", "r2", "a2", T0 + dt.timedelta(seconds=1))], schema)
    anom = spark.createDataFrame([("b", "r1", "a1", T0)], schema)
    got = incident.find_incident(fail, anom)
    assert got["incident_type"] == "failure" and got["stage_run_id"] == "r2"
    with pytest.raises(incident.NoIncidentError):
        incident.find_incident(fail.limit(0), anom.limit(0))
    lin = spark.createDataFrame([("r1", "a1", "silver.t", ["bronze.t"], "op")],
                                "stage_run_id string, artifact_id string, downstream_table string, "
                                "upstream_tables array<string>, operation string")
    rec = {r.stage_run_id: r for r in incident.lineage_record(
        spark.createDataFrame([("r1", "a1"), ("r2", "a2")], "stage_run_id string, artifact_id string"),
        lin).collect()}
    assert rec["r1"].downstream_table == "silver.t" and rec["r2"].downstream_table is None


@pytest.mark.parametrize("seed,max_depth", [(4, 5), (5, 1), (6, 9)])
def test_closure_depth_bounds(spark, seed, max_depth):
    rnd = random.Random(seed)
    n = 30
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(45)}
    starts = rnd.sample(range(n), 3)
    e = spark.createDataFrame(sorted(edges), "child long, parent long")
    s = spark.createDataFrame([(x,) for x in starts], "node long")
    got = {r.node: r.depth for r in incident.lineage_closure(e, s, max_depth=max_depth).collect()}
    assert got == bfs(edges, starts, max_depth)


def test_closure_long_chain(spark):
    chain = [(i, i + 1) for i in range(12)]
    e = spark.createDataFrame(chain, "child long, parent long")
    s = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.depth for r in incident.lineage_closure(e, s, max_depth=20).collect()}
    assert got == {i: i for i in range(13)}
    cut = incident.lineage_closure(e, s, max_depth=7).collect()
    assert {r.node: r.depth for r in cut} == {i: i for i in range(8)}
    assert all(r.truncated for r in cut)
    assert not any(r.truncated for r in incident.lineage_closure(e, s, max_depth=12).collect())


def test_closure_has_no_depth_bound(spark):
    e = spark.range(299).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    s = spark.createDataFrame([(0,)], "node long")
    out = incident.lineage_closure(e, s)
    assert out.columns == ["node", "depth"]
    assert {r.node: r.depth for r in out.collect()} == {i: i for i in range(300)}


def test_closure_of_a_hub(spark):
    """One child with a third of all edges, and NULL parents."""
    hub = [(0, i) for i in range(1, 401)]
    e = spark.createDataFrame(hub + [(i, i + 1000) for i in range(1, 801)] + [(5, None)],
                              "child long, parent long")
    s = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.depth for r in incident.lineage_closure(e, s).collect()}
    want = {0: 0, **{i: 1 for i in range(1, 401)}, **{i + 1000: 2 for i in range(1, 401)}}
    assert got == want


def test_full_ranking_equals_a_plain_sort(spark):
    rnd = random.Random(9)
    rows = [(g, n, rnd.randrange(4), rnd.choice([1, 2, 3]), rnd.randrange(3))
            for g in ("a", "b") for n in range(60)]
    closure = spark.createDataFrame([(g, n, d) for g, n, d, _, _ in rows],
                                    "g string, node long, depth int")
    ev = spark.createDataFrame([(g, n, s, t) for g, n, _, s, t in rows],
                               "g string, node long, severity int, ts int")
    got = {(r.g, r.node): r["rank"] for r in
           incident.rank_root_causes(closure, ev, group=["g"], ts="ts").collect()}
    for g in ("a", "b"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], -r[3], r[4], r[1]))
        assert {(g, r[1]): i + 1 for i, r in enumerate(order)} == \
            {k: v for k, v in got.items() if k[0] == g}
    top = incident.rank_root_causes(closure, ev, group=["g"], ts="ts", top=3)
    assert {(r.g, r.node): r["rank"] for r in top.collect()} == {k: v for k, v in got.items() if v <= 3}


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_ev = st.lists(st.tuples(st.sampled_from(["r1", "r2", "r3"]), st.integers(0, 5),
                         st.integers(0, 10_000)), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(fails=_ev, anoms=_ev)
def test_incident_choice_property(spark, fails, anoms):
    schema = "run string, ts timestamp, id long"
    to_rows = (lambda xs: [(r, T0 + dt.timedelta(seconds=s), i) for r, s, i in xs])
    f, a = spark.createDataFrame(to_rows(fails), schema), spark.createDataFrame(to_rows(anoms), schema)
    got = {r.run: (r.incident_type, r.ts) for r in
           incident.incident_choice(f, a, by=["run"], ts="ts", cols=["id"]).collect()}
    want = {}
    for run in {r for r, _, _ in fails + anoms}:
        lf = max((s for r, s, _ in fails if r == run), default=None)
        la = max((s for r, s, _ in anoms if r == run), default=None)
        if lf is not None and (la is None or lf > la):
            want[run] = ("failure", T0 + dt.timedelta(seconds=lf))
        else:
            want[run] = ("anomaly", T0 + dt.timedelta(seconds=la))
    assert got == want


@pytest.mark.parametrize("seed", [11, 12])
def test_grouped_closure_matches_bfs_per_group(spark, seed):
    rnd = random.Random(seed)
    rows, starts = [], []
    want = {}
    for g in ("b1", "b2", "b3"):
        edges = {(rnd.randrange(15), rnd.randrange(15)) for _ in range(25)}
        rows += [(g, c, p) for c, p in sorted(edges)]
        st_nodes = rnd.sample(range(15), 2)
        starts += [(g, s) for s in st_nodes]
        want.update({(g, n): d for n, d in bfs(edges, st_nodes, 8).items()})
    e = spark.createDataFrame(rows, "batch_id string, child long, parent long")
    s = spark.createDataFrame(starts, "batch_id string, node long")
    got = {(r.batch_id, r.node): r.depth
           for r in incident.lineage_closure(e, s, max_depth=8, group=["batch_id"]).collect()}
    assert got == want
