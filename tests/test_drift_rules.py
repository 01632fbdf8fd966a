"""Schema diff, contracts and validation rules."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, FloatType, IntegerType, LongType, StringType,
                               StructField, StructType)

from conftest import SF01
from tierlake.operators import drift
from tierlake.operators.rules import Rule, validate
from tierlake.plans import catalog


def test_schema_diff():
    exp = StructType([StructField("a", IntegerType()), StructField("b", FloatType()),
                      StructField("c", StringType())])
    act = StructType([StructField("a", IntegerType()), StructField("b", DoubleType()),
                      StructField("d", StringType())])
    rows = sorted(drift.schema_diff(exp, act))
    assert rows == [("b", "type_change", "float", "double", False),
                    ("c", "missing", "string", None, False),
                    ("d", "extra", None, "string", True)]
    assert drift.schema_diff(exp, exp) == []


def test_catalog_drift(spark):
    e = drift.schema_frame(spark, {"t": StructType([StructField("a", LongType()),
                                                    StructField("b", StringType())])})
    a = drift.schema_frame(spark, {"t": StructType([StructField("a", IntegerType()),
                                                    StructField("c", StringType())])})
    got = sorted((r.column_name, r.change) for r in drift.catalog_drift(e, a).collect())
    assert got == [("a", "type_change"), ("b", "missing"), ("c", "extra")]


def test_conform_rules(spark):
    df = spark.createDataFrame([("1", "x", "e")], "k string, name string, extra string")
    contract = StructType([StructField("k", LongType()), StructField("name", StringType()),
                           StructField("missing", IntegerType())])
    out = drift.conform(df, contract, drift.EvolutionRules(allow_new_columns=False))
    assert out.columns == ["k", "name", "missing"] and out.first() == (1, "x", None)
    kept = drift.conform(df, contract, drift.EvolutionRules(allow_new_columns=True))
    assert kept.columns == ["k", "name", "missing", "extra"]
    with pytest.raises(drift.SchemaContractError):
        drift.conform(df, contract, drift.EvolutionRules(strict_mode=True))
    with pytest.raises(drift.SchemaContractError):
        drift.conform(df.drop("extra"), StructType([StructField("k", LongType())]),
                      drift.EvolutionRules(auto_cast_types=False, strict_mode=True,
                                           allow_new_columns=True))


def test_rules_match_manual_counts(spark):
    li = catalog.table(spark, SF01, "lineitem")
    res = {r.rule_id: r for r in validate(li, [
        Rule("q", "l_quantity", "min", 1.0), Rule("d", "l_discount", "max", 0.08),
        Rule("f", "l_returnflag", "in_set", ["R", "A"]), Rule("z", "l_quantity", "zscore", 1.5),
        Rule("n", "l_shipdate", "null_ratio", 0.0)]).collect()}
    assert res["d"].failed_rows == li.where("l_discount > 0.08").count()
    assert res["f"].failed_rows == li.where("l_returnflag not in ('R', 'A')").count()
    st = li.agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s")).first()
    z = li.where(F.abs(F.col("l_quantity") - st.m) / st.s > 1.5).count()
    assert res["z"].failed_rows == z and res["z"].status == ("FAILED" if z else "PASSED")
    assert res["n"].status == "PASSED" and res["q"].total_rows == li.count()


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_rrows = st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)),
                            st.sampled_from(["ab1", "AB", "x", None])), min_size=0, max_size=20)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=_rrows)
def test_rules_property(spark, rows):
    import re
    df = spark.createDataFrame(rows, "v int, s string")
    rules = [Rule("nn", "v", "not_null"), Rule("mn", "v", "min", 0), Rule("mx", "v", "max", 3),
             Rule("in", "s", "in_set", ["AB", "x"]), Rule("rx", "s", "regex", r"^[a-z]+\d$"),
             Rule("nr", "s", "null_ratio", 0.25)]
    got = {r.rule_id: (r.failed_rows, r.status) for r in validate(df, rules).collect()}
    n = len(rows)
    vs, ss = [r[0] for r in rows], [r[1] for r in rows]
    counts = {"nn": sum(v is None for v in vs), "mn": sum(v is not None and v < 0 for v in vs),
              "mx": sum(v is not None and v > 3 for v in vs),
              "in": sum(s is not None and s not in ("AB", "x") for s in ss),
              "rx": sum(s is not None and not re.search(r"^[a-z]+\d$", s) for s in ss),
              "nr": sum(s is None for s in ss)}
    want = {k: (c, "FAILED" if (c > 0 if k != "nr" else n > 0 and c / n > 0.25) else "PASSED")
            for k, c in counts.items()}
    assert got == want


def test_nested_drift(spark):
    parse = StructType.fromDDL
    old = parse("a struct<x:int, y:struct<z:string>, gone:struct<k:int, l:int>>, b array<struct<p:float>>, "
                "m map<string,int>, same array<int>, kind array<struct<q:int>>, `odd.name` int")
    new = parse("a struct<x:bigint, y:struct<z:string, w:date>>, b array<struct<p:double>>, m map<string,bigint>, "
                "same array<int>, kind string, `odd.name` bigint, extra struct<e:int>")
    got = drift.nested_drift(drift.path_frame(spark, {"t": old, "u": old}), drift.path_frame(spark, {"t": new, "u": old}))
    assert sorted((r.table_name, r.column_name, r.change, r.expected_type, r.actual_type) for r in got.collect()) == [
        ("t", "`odd.name`", "type_change", "int", "bigint"), ("t", "a.gone", "missing", "struct", None),
        ("t", "a.x", "type_change", "int", "bigint"), ("t", "a.y.w", "extra", None, "date"),
        ("t", "b[].p", "type_change", "float", "double"), ("t", "extra", "extra", None, "struct"),
        ("t", "kind", "type_change", "array", "string"), ("t", "m{}", "type_change", "int", "bigint")]
    empty = drift.path_frame(spark, {})
    assert drift.nested_drift(empty, empty).count() == 0
    assert {r.change for r in drift.nested_drift(drift.path_frame(spark, {"t": new}), empty).collect()} == {"missing"}


def test_conform_inside_columns(spark, ansi):
    df = spark.createDataFrame(
        [(("7", "x"), [("1.5", 1), None], {1: "3"}), (None, None, None), (("bad", None), [], {2: "no", 3: None})],
        "s struct<n:string, more:string>, a array<struct<v:string, w:int>>, m map<int,string>")
    contract = StructType.fromDDL("s struct<new:date, n:int>, a array<struct<w:bigint, v:double>>, m map<bigint,int>")
    out = drift.conform(df, contract, drift.EvolutionRules(allow_new_columns=False))
    assert [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in contract]
    got = [r.asDict(recursive=True) for r in out.collect()]
    assert got == [
        {"s": {"new": None, "n": 7}, "a": [{"w": 1, "v": 1.5}, None], "m": {1: 3}},
        {"s": None, "a": None, "m": None},
        {"s": {"new": None, "n": None}, "a": [], "m": {2: None, 3: None}}]
    kept = drift.conform(df, contract)
    assert kept.schema["s"].dataType.fieldNames() == ["new", "n", "more"]
    for bad in ("s string, a int, m map<bigint,int>", "s struct<n:int>, a array<struct<v:int>>, m map<date,string>"):
        with pytest.raises(drift.SchemaContractError):
            drift.conform(df, StructType.fromDDL(bad))
    with pytest.raises(drift.SchemaContractError):
        drift.conform(df, contract, drift.EvolutionRules(strict_mode=True))
