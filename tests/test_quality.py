"""Fused quality pass: equals one-check-at-a-time, handles empty and NULL keys."""

from pyspark.sql import functions as F

from conftest import SF01
from tierlake.operators import quality
from tierlake.operators.dedupe import dedupe
from tierlake.operators.quality import Checks
from tierlake.plans import catalog


def one_at_a_time(df, checks):
    out = {"row_count": df.count()}
    if checks.keys:
        out["null_key_rows"] = df.where(quality.any_null(list(checks.keys))).count()
        out["duplicate_key_groups"] = (df.groupBy(*checks.keys).count()
                                       .where(F.col("count") > 1).count())
    for c in (*checks.critical, *checks.metrics):
        out[f"null__{c}"] = df.where(F.col(c).isNull()).count()
    for c in quality._numeric_metrics(df, checks):
        out[f"neg__{c}"] = df.where(F.col(c) < 0).count()
    return out


def test_fused_equals_separate_checks(spark):
    silver = catalog.fact_clean(spark, SF01)
    fused = quality.profile(silver, catalog.SILVER_ITEM_CHECKS).first().asDict()
    assert fused == one_at_a_time(silver, catalog.SILVER_ITEM_CHECKS)
    gold = catalog.fact_mart(spark, SF01)
    fused = quality.profile(gold, catalog.GOLD_ITEM_CHECKS).first().asDict()
    assert fused == one_at_a_time(gold, catalog.GOLD_ITEM_CHECKS)


def test_duplicate_groups_on_lineitem(spark):
    li = catalog.table(spark, SF01, "lineitem")
    prof = quality.profile(li, Checks(keys=("l_orderkey", "l_linenumber"))).first()
    assert prof.duplicate_key_groups == 11785 and prof.null_key_rows == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k string, m double")
    checks = Checks(keys=("k",), metrics=("m",), min_rows=10, stage="gold")
    prof = quality.profile(empty, checks).first().asDict()
    assert all(v == 0 for v in prof.values())
    found = {r.check for r in quality.findings(empty, checks, "t").collect()}
    assert found == {"EMPTY_GOLD_DATASET", "LOW_ROW_COUNT"}


def test_null_keys_form_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), (None, 1), ("b", 2)],
                               "k1 string, k2 int")
    prof = quality.profile(df, Checks(keys=("k1", "k2"))).first()
    assert prof.null_key_rows == 3 and prof.duplicate_key_groups == 1 and prof.row_count == 5


def test_hot_key(spark):
    # One key holds a third of the rows: the counts stay exact.
    n = 30000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
                               .alias("k"), F.col("id").alias("v"))
    prof = quality.profile(df, Checks(keys=("k",))).first()
    assert prof.row_count == n and prof.duplicate_key_groups == 1
    assert dedupe(df, ["k"], order_by=["v"]).count() == n - n // 3 + 1
    hot = dedupe(df, ["k"], order_by=["v"]).where("k = -1").first()
    assert hot.v == 0


def test_split_valid_partitions_rows(spark):
    silver = catalog.fact_clean(spark, SF01)
    valid, bad = quality.split_valid(silver, catalog.ITEM_KEYS)
    assert valid.count() + bad.count() == silver.count()
    assert bad.where(F.col("item_seq").isNotNull() & F.col("order_id").isNotNull()).count() == 0


def test_findings_types(spark):
    f = quality.findings(catalog.table(spark, SF01, "customer"),
                         Checks(metrics=("c_acctbal", "c_name"), min_rows=5, stage="gold"), "customer")
    rows = f.collect()
    assert [r.check for r in rows] == ["NEGATIVE_BUSINESS_METRIC"]
    assert rows[0].column_name == "c_acctbal" and rows[0].failed_rows > 0


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]),
                           st.one_of(st.none(), st.integers(-2, 2)),
                           st.one_of(st.none(), st.floats(-5, 5, allow_nan=False))),
                 max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=_rows)
def test_fused_profile_property(spark, rows):
    df = spark.createDataFrame(rows, "k1 string, k2 int, m double")
    checks = Checks(keys=("k1", "k2"), critical=("k2",), metrics=("m",))
    got = quality.profile(df, checks).first().asDict()
    groups = {}
    for r in rows:
        groups[(r[0], r[1])] = groups.get((r[0], r[1]), 0) + 1
    assert got == {
        "row_count": len(rows),
        "null_key_rows": sum(1 for r in rows if r[0] is None or r[1] is None),
        "duplicate_key_groups": sum(1 for n in groups.values() if n > 1),
        "null__k2": sum(1 for r in rows if r[1] is None),
        "null__m": sum(1 for r in rows if r[2] is None),
        "neg__m": sum(1 for r in rows if r[2] is not None and r[2] < 0),
    }


_drows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3),
                            st.one_of(st.none(), st.integers(-3, 3)),
                            st.sampled_from(["x", "y", None])), min_size=1, max_size=25)


def _py_key(v, desc):
    # NULLs first ascending (last descending): (is-not-null, value) ordering
    return (v is not None, v if v is not None else 0)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=_drows, desc=st.booleans())
def test_ordered_dedupe_property(spark, rows, desc):
    df = spark.createDataFrame(rows, "k string, g int, o int, s string")
    got = {(r.k, r.g): (r.o, r.s) for r in dedupe(df, ["k", "g"], order_by=["o"],
                                                  descending=desc).collect()}
    want = {}
    for k, g, o, s in rows:
        cand = (o, s)
        cur = want.get((k, g))
        key = (_py_key(o, desc), _py_key(s, desc))
        if cur is None or (key > (_py_key(cur[0], desc), _py_key(cur[1], desc)) if desc
                           else key < (_py_key(cur[0], desc), _py_key(cur[1], desc))):
            want[(k, g)] = cand
    assert got == want


_odd = st.one_of(st.none(), st.text(st.sampled_from("\x00\x01\x02\x03\x05ab\u00e9"), max_size=3))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["a", None]), _odd, _odd, st.integers(0, 1), _odd, _odd),
                     min_size=1, max_size=25), desc=st.booleans())
def test_dedupe_orders_texts_carried_as_one(spark, rows, desc):
    # Control characters, NULLs and empty texts compare and come back as given.
    df = spark.createDataFrame(rows, "k string, s string, t string, i int, u string, v string")
    got = {r.k: tuple(r) for r in dedupe(df, ["k"], order_by=[], descending=desc).collect()}
    pick = max if desc else min
    assert got == {k: pick((r for r in rows if r[0] == k), key=lambda r: [
        (v is not None, v.encode() if isinstance(v, str) else v or 0) for v in r[1:]])
        for k in {r[0] for r in rows}}


def test_dedupe_sorts_and_shuffles_one_text(spark):
    # Sorts and the shuffle hold the row as key and one text, not 12 columns.
    silver = catalog.fact_clean(spark, SF01)
    plan = silver._jdf.queryExecution().executedPlan().toString()
    assert "_dedupe_text_0" in plan
    sort = next(line for line in plan.splitlines() if "Sort [" in line)
    assert sort.count("ASC NULLS FIRST") == 3
    # The schema stays as it was, with bytes that are no UTF-8 too.
    odd = spark.sql("select 'k' k, cast(X'80FF' as string) s, 'x' t, cast(null as string) u")
    out = dedupe(odd, ["k"], order_by=[])
    assert out.schema == odd.schema
    assert [tuple(map(bytes, r)) for r in out.select(F.col("s").cast("binary"),
                                                     F.col("t").cast("binary")).collect()] == [(b"\x80\xff", b"x")]
