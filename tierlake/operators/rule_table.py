"""Validation rules kept as a table and applied as data.

``validate_table`` gives the results of ``rules.validate`` for a DataFrame of
rules (rule_id, table_name, column_name, rule_type, value as JSON text,
severity). The rules are never collected: thousands or millions of them are
joined as data.

The checked columns are unpivoted to (column, text of the value) and counted
per distinct value, with partial counts before the shuffle; rules see distinct
values only. Rules that differ only in their id, table name or severity are one
check, evaluated once and joined back.

min, max and zscore don't meet values pairwise: the values and the bounds of a
column (of the distances from its mean for zscore) are sorted together in range
partitions of bounded size, and a running count gives each bound the rows below
it. Patterns meet the values of their column in a join on (column, salt): values
are dealt over ``salts`` by hash and the patterns repeated for each. Sets are
exploded to (column, value) and joined by equality, the counts repeated for each
salt, so neither a column nor a common item is one task's work. NULL counts,
totals, means and deviations per column come from the same counts.

Value counts, distinct checks and the sorted rows are stored under the scratch
folder, so one scan of the checked table serves them all.

Numbers are compared as doubles, dates and timestamps as timestamps, all else
as text. A rule that can't be applied (unknown column or type, a value that
doesn't parse) gets the status INVALID and NULL failed rows; equal rule rows
count once; a NULL severity is ERROR; an empty table violates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)
from pyspark.sql.window import Window

from tierlake.operators.rules import RESULT_COLUMNS
from tierlake.session import cut_lineage

RULE_COLUMNS = ["rule_id", "table_name", "column_name", "rule_type", "value", "severity"]
CHECK_COLUMNS = ["column_name", "rule_type", "value"]
ORDERED = ("min", "max", "zscore")
KINDS = (*ORDERED, "regex", "in_set", "not_null", "null_ratio")


def _kind(data_type) -> str | None:
    if isinstance(data_type, NumericType):
        return "number"
    if isinstance(data_type, (DateType, TimestampType, TimestampNTZType)):
        return "time"
    return "text" if isinstance(data_type, (StringType, BooleanType)) else None


def _as_text(value: Column, kind: str) -> Column:
    """One spelling per value: what ``_number`` and ``_time`` read back."""
    cast = {"number": "double", "time": "timestamp", "text": "string"}[kind]
    return value.cast(cast).cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, text, n): how often each value occurs in each column of
    a simple type (``columns`` only, if given); NULL is a value."""
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields if columns is None or f.name in columns}
    cells = [F.struct(F.lit(c).alias("column_name"), _as_text(F.col(f"`{c}`"), k).alias("text"))
             for c, k in kinds.items() if k]
    if not cells:
        return df.sparkSession.createDataFrame([], "column_name string, text string, n long")
    return df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.column_name", "c.text").agg(
        F.count(F.lit(1)).alias("n"))


def _number(text: str) -> Column:
    return F.col(text).try_cast("double")


def _time(text: str) -> Column:
    return F.col(text).try_cast("timestamp")


def _parsed(checks: DataFrame, df: DataFrame) -> DataFrame:
    """Checks with the kind of their column, their value as text (``bound``)
    and as a list of texts (``items``), and whether they apply."""
    pairs = [x for f in df.schema.fields if _kind(f.dataType)
             for x in (F.lit(f.name), F.lit(_kind(f.dataType)))]
    kind = F.create_map(*pairs)[F.col("column_name")] if pairs else F.lit(None).cast("string")
    boxed = F.concat(F.lit('{"v":'), F.col("value"), F.lit("}"))
    checks = checks.withColumns({
        "kind": kind, "bound": F.from_json(boxed, "v string")["v"],
        "items": F.from_json(boxed, "v array<string>")["v"]})
    one = {"number": F.col("bound").try_cast("double").isNotNull(),
           "time": F.col("bound").try_cast("timestamp").isNotNull(), "text": F.col("bound").isNotNull()}
    fits = F.coalesce(*[F.when(F.col("kind") == k, ok) for k, ok in one.items()], F.lit(False))
    need = (F.when(F.col("rule_type").isin("min", "max"), fits)
            .when(F.col("rule_type") == "zscore", fits & (F.col("kind") == "number"))
            .when(F.col("rule_type") == "null_ratio", F.col("bound").try_cast("double").isNotNull())
            .when(F.col("rule_type") == "regex", F.col("bound").isNotNull())
            .when(F.col("rule_type") == "in_set", F.col("items").isNotNull())
            .when(F.col("rule_type") == "not_null", F.lit(True)))
    return checks.withColumn("usable", F.col("kind").isNotNull() & F.coalesce(need, F.lit(False)))


def _column_totals(counts: DataFrame) -> DataFrame:
    """(column_name, total, nulls, mean, std); the deviation is that of a
    sample, about the mean."""
    number = _number("text")
    totals = counts.groupBy("column_name").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"))
    square = (_number("text") - F.col("mean")) ** 2 * F.col("n")
    spread = counts.join(F.broadcast(totals.select("column_name", "mean")), "column_name").groupBy("column_name").agg(
        F.sum(square).alias("square"))
    degrees = F.nullif(F.col("total") - F.col("nulls") - 1, F.lit(0))
    return totals.join(F.broadcast(spread), "column_name").select(
        "column_name", "total", "nulls", "mean", F.sqrt(F.col("square") / degrees).alias("std"))


def _of_columns(rows: DataFrame, checks: DataFrame, on: list[str]) -> DataFrame:
    """The rows of columns that a check is about (at most a few a column)."""
    return rows.join(F.broadcast(checks.select(*on).distinct()), on, "left_semi")


def _ordered(checks: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(check columns, bad): rows below a least value, above a greatest one or
    too far from the mean.

    A line is a column's values, or their distances from the mean. At equal
    keys a ``min`` bound stands before the values, other bounds after them, so
    the running count at a bound is the rows below it, or not above it."""
    line = ["column_name", "far"]
    key = ["number", "time", "text", "side"]
    bounds = checks.where(F.col("usable") & F.col("rule_type").isin(*ORDERED)).select(
        *CHECK_COLUMNS, (F.col("rule_type") == "zscore").alias("far"), *_keys("kind", "bound"),
        F.when(F.col("rule_type") == "min", 0).otherwise(2).alias("side"), F.lit(0).cast("long").alias("n"))
    kinds = checks.where("usable").select("column_name", "kind").distinct()
    values = counts.where(F.col("text").isNotNull()).join(F.broadcast(kinds), "column_name").join(
        F.broadcast(totals.select("column_name", "mean", "std")), "column_name")
    far = F.abs(_number("text") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    none = F.lit(None)
    rows = values.select("column_name", F.lit(False).alias("far"), *_keys("kind", "text"), "n").unionByName(
        values.where(F.col("kind") == "number").select(
            "column_name", F.lit(True).alias("far"), _plain_zero(far).alias("number"),
            none.cast("timestamp").alias("time"), none.cast("string").alias("text"), "n"))
    rows = _of_columns(rows.where(F.coalesce("number", F.col("time").cast("double"), F.length("text")).isNotNull()),
                       bounds, line).withColumn("side", F.lit(1))
    both = bounds.unionByName(rows, allowMissingColumns=True)
    stored = cut_lineage(both.repartitionByRange(*line, *key).withColumn("part", F.spark_partition_id()))
    parts = stored.groupBy(*line, "part").agg(F.sum("n").alias("here"))
    whole = Window.partitionBy(*line)
    parts = parts.withColumns({
        "before": F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all": F.sum("here").over(whole)}).drop("here")
    running = F.sum("n").over(Window.partitionBy(*line, "part").orderBy(*key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    found = stored.withColumn("running", running).where(F.col("side") != 1).join(parts, [*line, "part"])
    below = F.col("before") + F.col("running")
    return found.select(*CHECK_COLUMNS, F.when(F.col("side") == 0, below).otherwise(F.col("all") - below).alias("bad"))


def _plain_zero(number: Column) -> Column:
    return F.when(number == 0, F.lit(0.0)).otherwise(number)


def _keys(kind: str, text: str) -> list[Column]:
    """What texts of a kind are sorted by: a number, a time or the text."""
    k = F.col(kind)
    return [F.when(k == "number", _plain_zero(_number(text))).alias("number"),
            F.when(k == "time", _time(text)).alias("time"), F.when(k == "text", F.col(text)).alias("text")]


def _matched(checks: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """(check columns, bad): rows whose text doesn't match a pattern."""
    values = counts.where(F.col("text").isNotNull()).withColumn(
        "salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int"))
    patterns = checks.where(F.col("usable") & (F.col("rule_type") == "regex")).select(
        *CHECK_COLUMNS, "bound", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return values.join(patterns, ["column_name", "salt"]).where(~F.rlike("text", F.col("bound"))).groupBy(
        *CHECK_COLUMNS).agg(F.sum("n").alias("bad"))


def _members(checks: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """(check columns, inside): rows whose value is in the set."""
    def spelled(item: Column) -> Column:
        return (F.when(F.col("kind") == "number", item.try_cast("double").cast("string"))
                .when(F.col("kind") == "time", item.try_cast("timestamp").cast("string")).otherwise(item))

    sets = checks.where(F.col("usable") & (F.col("rule_type") == "in_set"))
    items = sets.select(*CHECK_COLUMNS, F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("salt"),
                        F.explode(F.array_distinct(F.transform("items", spelled))).alias("text"))
    values = _of_columns(counts.where(F.col("text").isNotNull()), sets, ["column_name"]).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return items.join(values, ["column_name", "text", "salt"]).groupBy(*CHECK_COLUMNS).agg(F.sum("n").alias("inside"))


def _same(left: str, right: str, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def validate_table(df: DataFrame, rules: DataFrame, columns: list[str] | None = None,
                   salts: int = 16) -> DataFrame:
    """One row per rule of the table: failed_rows, total_rows and PASSED,
    FAILED or INVALID. ``columns`` limits the columns that are counted (rules
    on others are INVALID), for callers who know which ones rules name. Runs
    jobs."""
    counts = cut_lineage(value_counts(df, columns))
    totals = _column_totals(counts)
    # Dealt out first: a few dense files of rules would be one task's hash table.
    rules = rules.select(*RULE_COLUMNS).repartition(*RULE_COLUMNS).distinct()
    checks = cut_lineage(_parsed(rules.select(*CHECK_COLUMNS).distinct(),
                                 df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])))
    found = _ordered(checks, counts, totals).unionByName(_matched(checks, counts, salts)).unionByName(
        _members(checks, counts, salts), allowMissingColumns=True)
    p = checks.alias("p").join(found.alias("f"), _same("p", "f", CHECK_COLUMNS), "left").select(
        "p.*", "f.bad", "f.inside")
    p = p.join(F.broadcast(totals), "column_name", "left").withColumns({
        c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", "nulls", "bad", "inside")})
    failed = (F.when(F.col("rule_type").isin("not_null", "null_ratio"), F.col("nulls"))
              .when(F.col("rule_type") == "in_set", F.col("total") - F.col("nulls") - F.col("inside"))
              .otherwise(F.col("bad")))
    broken = F.when(F.col("rule_type") == "null_ratio",
                    (F.col("total") > 0) & (F.col("nulls") / F.greatest("total", F.lit(1)) > _number("bound"))
                    ).otherwise(failed > 0)
    verdicts = p.select(
        *CHECK_COLUMNS, F.when(F.col("usable"), failed.cast("bigint")).alias("failed_rows"),
        F.col("total").alias("total_rows"),
        F.when(~F.col("usable"), "INVALID").when(broken, "FAILED").otherwise("PASSED").alias("status"))
    return rules.alias("r").join(verdicts.alias("v"), _same("r", "v", CHECK_COLUMNS), "left").select(
        "r.*", "v.failed_rows", "v.total_rows", "v.status").withColumn(
        "severity", F.coalesce("severity", F.lit("ERROR"))).select(*RESULT_COLUMNS)
