"""Data-quality checks fused into one aggregation pass.

A check set (``Checks``) describes one table: its key, the columns that
must not be NULL, the business metrics (must not be NULL, numeric ones must
not be negative) and a minimum row count. ``profile`` computes every count
in one job:

* without a key: one global aggregate (``count`` and ``count_if`` per
  column), partial-aggregated per task;
* with a key: one shuffle on the key. Per key it counts rows and per-column
  violations (combined map-side, so a hot key costs one row per task), then
  a global aggregate sums them and counts the keys seen more than once.
  NULL key parts form their own group, so rows with a NULL key are the sum
  of the counts of groups with a NULL part.

``findings`` turns the one-row profile into one row per violated check,
still without collecting anything to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tierlake.functions.clean import any_null

EMPTY_DATASET = "EMPTY_DATASET"
EMPTY_GOLD_DATASET = "EMPTY_GOLD_DATASET"
NULL_PRIMARY_KEY = "NULL_PRIMARY_KEY"
DUPLICATE_PRIMARY_KEYS = "DUPLICATE_PRIMARY_KEYS"
BUSINESS_RULE_VIOLATION = "BUSINESS_RULE_VIOLATION"
LOW_ROW_COUNT = "LOW_ROW_COUNT"
MISSING_BUSINESS_METRIC = "MISSING_BUSINESS_METRIC"
NEGATIVE_BUSINESS_METRIC = "NEGATIVE_BUSINESS_METRIC"

FINDINGS_SCHEMA = ("stage string, table_name string, check string, column_name string, "
                   "failed_rows bigint, expected bigint, actual bigint")


@dataclass(frozen=True)
class Checks:
    """What to check on one table.

    keys      key columns: NULL-key and duplicate-key checks
    critical  columns that must not be NULL (one finding per column)
    metrics   business metrics: NULL check, and negative check when numeric
    min_rows  minimum row count (None: no check)
    stage     'bronze' | 'silver' | 'gold' (gold reports EMPTY_GOLD_DATASET)
    """

    keys: tuple[str, ...] = ()
    critical: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    min_rows: int | None = None
    stage: str = "silver"
    duplicate_check: bool = True

    def __post_init__(self):
        for name in ("keys", "critical", "metrics"):
            v = getattr(self, name)
            if isinstance(v, str):
                object.__setattr__(self, name, (v,))
            else:
                object.__setattr__(self, name, tuple(v))


def _numeric_metrics(df: DataFrame, checks: Checks) -> list[str]:
    return [c for c in checks.metrics if isinstance(df.schema[c].dataType, NumericType)]


def _null_cols(checks: Checks) -> list[str]:
    seen: list[str] = []
    for c in (*checks.critical, *checks.metrics):
        if c not in seen:
            seen.append(c)
    return seen


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def row_metrics(df: DataFrame, checks: Checks,
                extra: dict[str, Column] | None = None) -> list[Column]:
    """Un-keyed metrics as aggregate expressions (usable with ``observe``).
    ``extra``: more named count aggregates computed in the same pass."""
    exprs = [F.count(F.lit(1)).alias("row_count")]
    if checks.keys:
        exprs.append(F.count_if(any_null(list(checks.keys))).alias("null_key_rows"))
    exprs += [F.count_if(F.col(c).isNull()).alias(f"null__{c}") for c in _null_cols(checks)]
    exprs += [F.count_if(F.col(c) < 0).alias(f"neg__{c}") for c in _numeric_metrics(df, checks)]
    exprs += [e.alias(name) for name, e in (extra or {}).items()]
    return exprs


def profile(df: DataFrame, checks: Checks, extra: dict[str, Column] | None = None) -> DataFrame:
    """One-row DataFrame with every count the checks need.

    Columns: row_count, null_key_rows, duplicate_key_groups (when keys),
    null__<col>, neg__<col>, and one column per ``extra`` count aggregate
    (e.g. rule violations, ``rules.rule_metrics``), all in the same pass.
    """
    null_cols = _null_cols(checks)
    neg_cols = _numeric_metrics(df, checks)
    extra = extra or {}
    if not checks.keys or not checks.duplicate_check:
        return df.agg(*row_metrics(df, checks, extra))
    keys = list(checks.keys)
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null__{c}") for c in null_cols],
        *[F.count_if(F.col(c) < 0).alias(f"neg__{c}") for c in neg_cols],
        *[e.alias(name) for name, e in extra.items()],
    )
    return per_key.agg(
        _z(F.sum("_n")).alias("row_count"),
        _z(F.sum(F.when(any_null(keys), F.col("_n")))).alias("null_key_rows"),
        F.count_if(F.col("_n") > 1).cast("bigint").alias("duplicate_key_groups"),
        *[_z(F.sum(f"null__{c}")).alias(f"null__{c}") for c in null_cols],
        *[_z(F.sum(f"neg__{c}")).alias(f"neg__{c}") for c in neg_cols],
        *[_z(F.sum(name)).alias(name) for name in extra],
    )


def _finding(check: str, column: str | None, failed: Column | None,
             expected: Column | int | None, actual: Column, violated: Column) -> Column:
    lit_or = (lambda v: v if isinstance(v, Column) else F.lit(v))
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column_name"),
        (failed if failed is not None else F.lit(None)).cast("bigint").alias("failed_rows"),
        lit_or(expected).cast("bigint").alias("expected"),
        actual.cast("bigint").alias("actual"),
        violated.alias("violated"),
    )


def finding_specs(prof_columns: list[str], checks: Checks, numeric: list[str]) -> list[Column]:
    rc = F.col("row_count")
    empty = EMPTY_GOLD_DATASET if checks.stage == "gold" else EMPTY_DATASET
    specs = [_finding(empty, None, None, 1, rc, rc == 0)]
    if checks.keys:
        key_name = ",".join(checks.keys)
        nk = F.col("null_key_rows")
        specs.append(_finding(NULL_PRIMARY_KEY, key_name, nk, 0, nk, nk > 0))
        if "duplicate_key_groups" in prof_columns:
            dk = F.col("duplicate_key_groups")
            specs.append(_finding(DUPLICATE_PRIMARY_KEYS, key_name, dk, 0, dk, dk > 0))
    for c in checks.critical:
        n = F.col(f"null__{c}")
        specs.append(_finding(BUSINESS_RULE_VIOLATION, c, n, 0, n, n > 0))
    if checks.min_rows is not None:
        specs.append(_finding(LOW_ROW_COUNT, None, None, checks.min_rows, rc,
                              rc < F.lit(checks.min_rows)))
    for c in checks.metrics:
        n = F.col(f"null__{c}")
        specs.append(_finding(MISSING_BUSINESS_METRIC, c, n, 0, n, n > 0))
    for c in numeric:
        n = F.col(f"neg__{c}")
        specs.append(_finding(NEGATIVE_BUSINESS_METRIC, c, n, 0, n, n > 0))
    return specs


def findings_from_profile(prof: DataFrame, checks: Checks, numeric: list[str],
                          table_name: str) -> DataFrame:
    specs = finding_specs(prof.columns, checks, numeric)
    return (
        prof.select(F.explode(F.array(*specs)).alias("f"))
        .where(F.col("f.violated"))
        .select(
            F.lit(checks.stage).alias("stage"),
            F.lit(table_name).alias("table_name"),
            "f.check", "f.column_name", "f.failed_rows", "f.expected", "f.actual",
        )
    )


def findings(df: DataFrame, checks: Checks, table_name: str) -> DataFrame:
    """One row per violated check (schema ``FINDINGS_SCHEMA``), one job."""
    return findings_from_profile(profile(df, checks), checks,
                                 _numeric_metrics(df, checks), table_name)


def findings_from_values(spark, values: dict, checks: Checks, numeric: list[str],
                         table_name: str) -> DataFrame:
    """Findings from already-computed metrics (e.g. an ``Observation``)."""
    cols = list(values)
    prof = spark.createDataFrame([tuple(int(values[c]) for c in cols)],
                                 ", ".join(f"`{c}` bigint" for c in cols))
    return findings_from_profile(prof, checks, numeric, table_name)


def bad_rows(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows with any NULL key part (all of them, no cap)."""
    return df.where(any_null(list(keys)))


def split_valid(df: DataFrame, keys: list[str] | tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows with a complete key, rows with a NULL key part)."""
    bad = any_null(list(keys))
    return df.where(~bad), df.where(bad)
