"""Rules as data, rescued rows, keys across loads, counted types, join audits:
each against a plain version."""

import json
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DecimalType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

from conftest import SF001
from tierlake.operators.join_audit import join_profile
from tierlake.operators.rule_table import validate_table
from tierlake.operators.rules import Rule, validate
from tierlake.plans import catalog_checks
from tierlake.session import scratch_path, scratch_root
from tierlake.sources import events as ev
from tierlake.sources.ingest import infer_schema
from tierlake.sources.lattice import BITS, DIGITS, cell_marks, load_observed, schema_of, type_of
from tierlake.sources.rescue import good_rows, load_rescued, read_csv_rescued
from tierlake.streaming import keystate
from tierlake.streaming.keystate import KeyState
from tierlake.streaming.landing import CSV_TEXT_OPTIONS, ingest_landing

# --------------------------------------------------------------------------
# Rules as data
# --------------------------------------------------------------------------

RULES = [
    Rule("a", "l_quantity", "min", 3.0), Rule("b", "l_quantity", "max", 40, "WARN"),
    Rule("c", "l_shipdate", "min", "1995-01-01"), Rule("d", "l_returnflag", "in_set", ["A", "N"]),
    Rule("e", "l_linenumber", "in_set", [1, 2, 3.0]), Rule("f", "l_returnflag", "regex", "^[AR]$"),
    Rule("g", "l_extendedprice", "zscore", 1.5), Rule("h", "l_tax", "null_ratio", 0.0),
    Rule("i", "l_tax", "not_null"), Rule("j", "l_linestatus", "max", "G"), Rule("k", "l_tax", "null_ratio", 0.9),
    Rule("l", "l_partkey", "max", 10**6), Rule("m", "l_discount", "zscore", 99)]


def rule_frame(spark, rules):
    rows = [(r.rule_id, r.table_name, r.column_name, r.rule_type,
             None if r.value is None else json.dumps(r.value), r.severity) for r in rules]
    return spark.createDataFrame(
        rows, "rule_id string, table_name string, column_name string, rule_type string, value string, severity string")


def as_set(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("salts", [1, 5])
def test_rule_table_equals_validate(spark, ansi, salts):
    items = spark.read.parquet(f"{SF001}/lineitem.parquet").withColumn(
        "l_tax", F.when(F.col("l_partkey") % 7 > 0, F.col("l_tax")))
    got = validate_table(items, rule_frame(spark, RULES), salts=salts)
    assert as_set(got) == as_set(validate(items, RULES))


def test_rule_table_of_odd_rules(spark):
    df = spark.createDataFrame([(1, "x", [1]), (None, None, None)], "n int, t string, a array<int>")
    rows = [("1", "", "zz", "min", "1", None), ("2", "", "n", "min", '"x"', "WARN"), ("3", "", "n", "odd", "1", None),
            ("4", "", "a", "not_null", None, None), ("5", "", "n", "in_set", "3", None),
            ("6", "", "t", "zscore", "1", None), ("7", None, "n", "in_set", "[]", None),
            ("8", "", "n", "max", "not json", None), ("9", "", "n", "not_null", None, None),
            ("9", "", "n", "not_null", None, None), ("10", "", "n", "zscore", "0", None), (None,) * 6]
    rules = spark.createDataFrame(
        rows, "rule_id string, table_name string, column_name string, rule_type string, value string, severity string")
    got = {r.rule_id: (r.status, r.failed_rows, r.total_rows) for r in validate_table(df, rules).collect()}
    assert len(got) == 11
    assert all(got[i][0] == "INVALID" and got[i][1] is None for i in ("1", "2", "3", "4", "5", "6", "8", None))
    assert got["7"] == ("FAILED", 1, 2) and got["9"] == ("FAILED", 1, 2) and got["10"] == ("PASSED", 0, 2)
    empty = {r.rule_id: r.status for r in validate_table(df.where("false"), rules).collect()}
    assert empty["9"] == "PASSED" and empty["2"] == "INVALID"
    assert validate_table(df, rules.where("false")).count() == 0


def test_rules_are_never_collected(spark):
    """The plan holds the rules as a scan and joins, not as literals."""
    rules = spark.range(3000).select(
        F.col("id").cast("string").alias("rule_id"), F.lit("t").alias("table_name"), F.lit("l_quantity").alias("column_name"),
        F.lit("min").alias("rule_type"), (F.col("id") % 50).cast("string").alias("value"), F.lit("ERROR").alias("severity"))
    items = spark.read.parquet(f"{SF001}/lineitem.parquet")
    counts = Counter(int(r.l_quantity) for r in items.collect())
    got = validate_table(items, rules, columns=["l_quantity"]).collect()
    assert len(got) == 3000
    for r in got:
        assert r.failed_rows == sum(n for v, n in counts.items() if v < int(r.rule_id) % 50)


def test_bounds_are_ranked_not_paired(spark):
    """Many distinct bounds of every kind against brute force; no join meets
    bounds with values."""
    df = spark.range(400).select(
        F.when(F.col("id") % 9 > 0, (F.col("id") % 90 - 40) / 2).alias("n"), F.when(F.col("id") == 3, float("nan")).otherwise(
            F.col("id") * -0.0).alias("z"), F.concat(F.lit("é"), F.col("id") % 70).alias("t"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 80).cast("int")).alias("d"))
    bounds = spark.range(-60, 60).withColumn("day", F.date_add(F.lit("2020-01-20").cast("date"), F.col("id").cast("int")))
    number = (F.col("id") / 2).cast("string")
    texts = {"n": number, "z": number, "t": F.concat(F.lit('"é'), F.col("id"), F.lit('"')),
             "d": F.concat(F.lit('"'), F.col("day"), F.lit('"'))}
    rules = None
    for column, value in texts.items():
        for kind in ("min", "max", "zscore") if column == "n" else ("min", "max"):
            one = bounds.select(F.concat_ws("_", F.lit(column), F.lit(kind), "id").alias("rule_id"), F.lit("x").alias("table_name"),
                                F.lit(column).alias("column_name"), F.lit(kind).alias("rule_type"), value.alias("value"),
                                F.lit("WARN").alias("severity"))
            rules = one if rules is None else rules.unionByName(one)
    got = validate_table(df, rules)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "= min)" not in plan and "rlike" in plan.lower()
    held = [Rule(r.rule_id, r.column_name, r.rule_type, json.loads(r.value), r.severity, r.table_name) for r in rules.collect()
            if int(r.rule_id.split("_")[2]) % 6 == 0]
    names = {h.rule_id for h in held}
    assert as_set(got.where(F.col("rule_id").isin(*names))) == as_set(validate(df, held)) and got.count() == rules.count()


# --------------------------------------------------------------------------
# Rescued rows
# --------------------------------------------------------------------------

SCHEMA = StructType([StructField("id", IntegerType()), StructField("price", DoubleType()),
                     StructField("day", DateType()), StructField("name", StringType())])
LINES = ["id,price,day,name", "1,2.5,2024-01-01,a", "x,2.5,2024-01-01,b", "3,,2024-01-01,", "4,1,soon,d",
         "y,z,2024-13-01,e", "6,1", "7,1,2024-01-01,g,more", '8,1,2024-01-01,"q,r"', "", "99999999999,1,2024-01-01,k"]


def write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_every_row_is_loaded_or_rescued(spark):
    root = scratch_path(spark, "t_rescue")
    write_lines(spark, f"{root}/raw", LINES)
    rows = {r.rescued_line or r.name: r for r in read_csv_rescued(spark, f"{root}/raw", SCHEMA).collect()}
    assert len(rows) == 9 and {k for k, r in rows.items() if r.rescued_reason is None} == {"a", None, "q,r"}
    assert {k[0]: (r.rescued_reason, r.rescued_columns) for k, r in rows.items() if r.rescued_reason} == {
        "x": ("values", ["id"]), "4": ("values", ["day"]), "y": ("values", ["id", "price", "day"]),
        "6": ("fields", None), "7": ("fields", None), "9": ("values", ["id"])}
    assert rows["x,2.5,2024-01-01,b"].price == 2.5
    for _ in range(2):  # a repeated load overwrites
        done = load_rescued(spark, f"{root}/raw", SCHEMA, f"{root}/b", f"{root}/t", "b", "r", "a", "p")
        assert (done.good, done.rescued) == (3, 6)
    assert sorted(r.id for r in good_rows(spark, f"{root}/b", SCHEMA).collect()) == [1, 3, 8]
    bad = ev.read_events(spark, f"{root}/t", "quarantine_record").collect()
    assert len(bad) == 12 and {r.error_type for r in bad} == {"SCHEMA_MISMATCH"}
    assert json.loads(bad[0].raw_record)["rescued_line"] in LINES


def test_rescue_of_clean_and_empty_files(spark):
    root = scratch_path(spark, "t_rescue2")
    write_lines(spark, f"{root}/clean", LINES[:2])
    write_lines(spark, f"{root}/empty", LINES[:1])
    args = f"{root}/t", "b", "r", "a", "p"
    assert load_rescued(spark, f"{root}/clean", SCHEMA, f"{root}/b1", *args).rescued == 0
    done = load_rescued(spark, f"{root}/empty", SCHEMA, f"{root}/b2", *args)
    assert (done.good, done.rescued) == (0, 0)
    assert ev.read_events(spark, f"{root}/t").count() == 0
    with pytest.raises(ValueError, match="clash"):
        read_csv_rescued(spark, f"{root}/clean", StructType([StructField("rescued_line", StringType())]))


# --------------------------------------------------------------------------
# Keys across loads
# --------------------------------------------------------------------------

KEYS = StructType([StructField("k", StringType()), StructField("i", LongType())])


def test_keys_across_batches_and_replays(spark):
    state = KeyState(scratch_path(spark, "t_keys"), KEYS, buckets=4)
    batches = [[("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("d", 2), ("d", 2), (None, 1)], [("e", 5)],
               [("a", 1)] * 500 + [("é", None)], []]
    total = Counter()
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, "x") for r in rows], "k string, i long, n string").repartition(3)
        new = Counter(r for r in rows if None not in r)
        total += new
        want = {(*k, total[k], c) for k, c in new.items() if total[k] > 1}
        for _ in range(2):  # the second time is a replay
            assert {tuple(r) for r in state.merge(df, n).collect()} == want
        assert {tuple(r) for r in state.duplicates(spark).collect()} == {
            (*k, c) for k, c in total.items() if c > 1}
    stored = state.versions(spark)
    assert all(len(v) <= 2 for v in stored.values())
    assert {(r.k, r.i): r.n for r in state.current(spark).collect()} == dict(total)


def test_only_changed_buckets_are_rewritten(spark):
    state = KeyState(scratch_path(spark, "t_keys2"), KEYS, buckets=64)
    state.merge(spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").alias("i")), 0)
    state.merge(spark.createDataFrame([("5", 5)], KEYS), 1)
    assert sum(1 in v for v in state.versions(spark).values()) == 1


def test_large_buckets_are_merged_in_slices(spark, monkeypatch):
    monkeypatch.setattr(keystate, "SLICE_ROWS", 100)
    state = KeyState(scratch_path(spark, "t_keys3"), KEYS, buckets=2)
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 1500).alias("i"))
    state.merge(rows, 0)
    assert state.merge(rows.where("id < 700"), 1).count() == 700
    assert state.current(spark).count() == 2000 and state.duplicates(spark).count() == 700
    files = state.current(spark).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 10 and max(r["count"] for r in files) < 400


def test_landing_reports_keys_of_earlier_drops(spark):
    root = scratch_path(spark, "t_landing_keys")
    schema = StructType([StructField("k", StringType()), StructField("v", StringType())])
    state = KeyState(f"{root}/keys", StructType(schema.fields[:1]), buckets=3)
    for rows in ([("a", "1"), ("b", "1")], [("c", "1")], [("a", "2"), ("c", "3"), ("c", "4")]):
        (spark.createDataFrame(rows, schema).write.mode("append").option("header", True)
         .options(**CSV_TEXT_OPTIONS).csv(f"{root}/in"))
        ingest_landing(spark, f"{root}/in", schema, f"{root}/out", f"{root}/ck", telemetry_root=f"{root}/t",
                       key_state=state)
    found = ev.read_events(spark, f"{root}/t", "anomaly").collect()
    assert [(r.anomaly_type, r.failed_rows) for r in found] == [("DUPLICATE_KEYS_ACROSS_LOADS", 3)]
    assert {tuple(r) for r in state.duplicates(spark).collect()} == {("a", 2), ("c", 3)}


# --------------------------------------------------------------------------
# Types counted by the load
# --------------------------------------------------------------------------

@pytest.mark.parametrize("name", [*catalog_checks.LANDED, "events", "labels"])
def test_counted_types_equal_inference(spark, name):
    root = scratch_path(spark, "t_types")
    spark.read.parquet(f"{SF001}/{name}.parquet").write.option("header", True).csv(f"{root}/raw")
    assert load_observed(spark, f"{root}/raw", f"{root}/out") == infer_schema(spark, f"{root}/raw")


def test_counted_types_of_odd_texts(spark):
    columns = {
        "whole": ["1", "-2", "+3", ""], "long": ["1", "99999999999"], "big": ["1", "12345678901234567890"],
        "real": ["1", "2.5", "1e5", "NaN"], "day": ["2024-01-01", ""], "time": ["2024-01-01", "2024-01-01 10:00:00"],
        "truth": ["true", "FALSE"], "mixed": ["1", "2024-01-01"], "none": ["", ""], "text": ["a", "1"],
        "bad_day": ["2024-13-01", "2024-01-01"]}
    rows = [tuple((v[i] if i < len(v) else None) for v in columns.values()) for i in range(4)]
    root = scratch_path(spark, "t_types2")
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).write.option("header", True).csv(f"{root}/raw")
    got = load_observed(spark, f"{root}/raw", f"{root}/out")
    assert got == infer_schema(spark, f"{root}/raw")
    assert got["big"].dataType == DecimalType(20, 0) and got["time"].dataType == TimestampType()


def test_marks_equal_the_casts(spark, ansi):
    """A cell's marks are what trying every cast would find."""
    texts = ["0", "-0", "+7", "007", "2147483647", "2147483648", "-2147483648", "0002147483648", "9223372036854775807",
             "9223372036854775808", "-9223372036854775808", "1" * 40, "1.", ".5", ".", "1e5", "1e", "1d", "2F", " 3 ", "NaN", "nan",
             "-Inf", "infinity", "0x1p3", "Indigo", "2024", "2024-01-01", "2024-13-01", "2024-1-1", "2024-01-01T10:00:00.000Z",
             "T10:00", "10:00", "true", "TRUE", "tru", "+", "a", "1\u2028"]
    got = spark.createDataFrame([(t,) for t in ["", None, *texts]], "t string").select("t", cell_marks(F.col("t")).alias("m"), *[
        F.col("t").try_cast(k).isNotNull().alias(k) for k in ("int", "bigint", "double", "date", "timestamp")]).collect()
    for r in got:
        if not r.t:
            assert r.m is None
            continue
        whole = re.fullmatch(r"[+-]?[0-9]+", r.t) is not None
        want = {"texts": True, "wholes": whole, "ints": whole and r.int, "longs": whole and r.bigint, "doubles": r.double,
                "dates": re.fullmatch(r"\d{4}-\d\d-\d\d", r.t) is not None and r.date, "times": r.timestamp,
                "truths": r.t.lower() in ("true", "false")}
        assert {k: bool(r.m & b) for k, b in BITS.items()} == want, r
        assert r.m // DIGITS == (len(r.t.lstrip("+-").lstrip("0")) if whole else 0)


def test_observed_load_conforms_and_reads_once(spark):
    root = scratch_path(spark, "t_types3")
    spark.createDataFrame([("7", "x", "q"), ("8.5", "y", "r")], "b string, a string, c string").write.option(
        "header", True).csv(f"{root}/raw")
    declared = StructType([StructField("a", StringType()), StructField("b", IntegerType()), StructField("d", DoubleType())])
    found = load_observed(spark, f"{root}/raw", f"{root}/out", declared)
    assert found["b"].dataType == DoubleType() and found.fieldNames() == ["b", "a", "c"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect()) == [("x", 7, None), ("y", 8, None)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-10**22, 10**22), min_size=1), st.integers(0, 5))
def test_counts_of_parts_add_up(values, cut):
    def count(v):
        whole = [str(x) for x in v]
        return {"texts": len(v), "wholes": len(v), "ints": sum(-2**31 <= x < 2**31 for x in v),
                "longs": sum(-2**63 <= x < 2**63 for x in v), "doubles": len(v), "dates": 0, "times": 0, "truths": 0,
                "digits": max((len(re.sub("^-?0*", "", x)) for x in whole), default=0)}
    a, b, whole = count(values[:cut]), count(values[cut:]), count(values)
    merged = {k: max(a[k], b[k]) if k == "digits" else a[k] + b[k] for k in whole}
    assert type_of(merged) == type_of(whole)
    assert schema_of(["x"], {f"c0_{k}": v for k, v in merged.items()}).fields[0].dataType == type_of(whole)


# --------------------------------------------------------------------------
# Join audits
# --------------------------------------------------------------------------

keys = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abc")), st.integers(0, 2)), max_size=12)


@settings(max_examples=12, deadline=None)
@given(keys, keys)
def test_profile_equals_real_joins(spark, left, right):
    a = spark.createDataFrame(left, "x string, y int")
    b = spark.createDataFrame(right, "u string, v int")
    got = join_profile(a, b, ["x", "y"], ["u", "v"]).first().asDict()
    on = (F.col("x") == F.col("u")) & (F.col("y") == F.col("v"))
    rights = Counter(right)
    assert got["inner_rows"] == a.join(b, on).count()
    assert got["left_join_rows"] == a.join(b, on, "left").count()
    assert got["extra_rows"] == got["left_join_rows"] - len(left)
    assert (got["left_rows"], got["right_rows"]) == (len(left), len(right))
    assert got["left_null_keys"] == sum(x is None for x, _ in left)
    assert got["left_unmatched"] == sum(k[0] is not None and k not in rights for k in left)
    assert got["right_unmatched"] == sum(k[0] is not None and k not in set(left) for k in right)
    assert got["left_multiplied"] == sum(k[0] is not None and rights[k] > 1 for k in left)
    assert got["max_matches"] == max((rights[k] for k in left if k[0] is not None), default=0)


def test_profile_of_a_hot_key_counts_before_the_shuffle(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    got = join_profile(hot, hot, ["k"]).first()
    assert got.inner_rows == 10_000 ** 2 + 20_000 and got.max_matches == 10_000
    with pytest.raises(ValueError):
        join_profile(hot, hot, [])


# --------------------------------------------------------------------------
# Drift of the catalog
# --------------------------------------------------------------------------

def test_catalog_lands_compressed(spark):
    assert catalog_checks.catalog_drift(spark, SF001).count() == 14
    files = Path(urlparse(scratch_root(spark)).path).glob("tierlake/json_*/part-*")
    assert {"".join(f.suffixes[-2:]) for f in files} == {".json.gz"}
