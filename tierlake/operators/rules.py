"""Declarative validation rules applied to a DataFrame in one pass.

Rule kinds (``Rule.rule_type``):

  not_null     value must not be NULL
  min / max    value must be >= / <= ``value``
  in_set       value must be one of ``value`` (a list)
  regex        non-NULL value must match ``value`` (a Java regex)
  zscore       |x - mean| / stddev must not exceed ``value``
  null_ratio   share of NULLs must not exceed ``value``

``validate`` evaluates every rule with one ``count_if`` each in a single
aggregate. The z-score rules need means and standard deviations first: one
aggregate computes them for every z-score column (a single row, read on
the driver and inlined as literals), so the table is scanned twice in
total however many rules there are, with no cross join.

Result: one row per rule (``RESULT_COLUMNS``); status is PASSED or FAILED.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ["rule_id", "table_name", "column_name", "rule_type", "severity",
                  "failed_rows", "total_rows", "status"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    column_name: str
    rule_type: str
    value: object = None
    severity: str = "ERROR"
    table_name: str = ""


def _zscore_stats(df: DataFrame, rules: list[Rule]) -> dict[str, tuple]:
    """Mean and sample standard deviation of every z-score column, all in
    one aggregate (one scan; the result is a single row)."""
    cols = sorted({r.column_name for r in rules if r.rule_type == "zscore"})
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def _violations(df: DataFrame, r: Rule, stats: dict[str, tuple]) -> Column:
    c = F.col(r.column_name)
    t = r.rule_type
    if t == "not_null":
        return F.count_if(c.isNull())
    if t == "min":
        return F.count_if(c < F.lit(r.value))
    if t == "max":
        return F.count_if(c > F.lit(r.value))
    if t == "in_set":
        return F.count_if(c.isNotNull() & ~c.isin(*list(r.value)))
    if t == "regex":
        return F.count_if(c.isNotNull() & ~c.rlike(str(r.value)))
    if t == "zscore":
        mean, std = stats[r.column_name]
        if mean is None or not std:
            return F.count_if(F.lit(False))
        return F.count_if(F.abs(c - F.lit(mean)) / F.lit(std) > F.lit(float(r.value)))
    if t == "null_ratio":
        return F.count_if(c.isNull())
    raise ValueError(f"unknown rule type {t!r}")


def rule_metrics(df: DataFrame, rules: list[Rule]) -> dict[str, Column]:
    """One violation-count aggregate per rule, named ``rule__<i>``. Counts
    add up across groups, so they can ride along in another aggregation
    pass (``quality.profile(..., extra=...)``)."""
    stats = _zscore_stats(df, rules)
    return {f"rule__{i}": _violations(df, r, stats).cast("bigint") for i, r in enumerate(rules)}


def is_failed(rule: Rule, failed: int, total: int) -> bool:
    if rule.rule_type == "null_ratio":
        return total > 0 and failed / total > float(rule.value)
    return failed > 0


def results_from_counts(rules: list[Rule], counts: dict, total: int) -> list[dict]:
    """Rule results from already-computed counts (one dict per rule)."""
    out = []
    for i, r in enumerate(rules):
        failed = int(counts[f"rule__{i}"])
        out.append({"rule_id": r.rule_id, "table_name": r.table_name,
                    "column_name": r.column_name, "rule_type": r.rule_type,
                    "severity": r.severity, "failed_rows": failed, "total_rows": int(total),
                    "status": "FAILED" if is_failed(r, failed, total) else "PASSED"})
    return out


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: failed_rows, total_rows and PASSED / FAILED."""
    if not rules:
        raise ValueError("no rules")
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [e.alias(f"_r{i}") for i, e in enumerate(rule_metrics(df, rules).values())]
    one = df.agg(*aggs)
    specs = []
    for i, r in enumerate(rules):
        failed = F.col(f"_r{i}")
        total = F.col("_total").cast("bigint")
        if r.rule_type == "null_ratio":
            bad = F.when(total > 0, failed / total > F.lit(float(r.value))).otherwise(F.lit(False))
        else:
            bad = failed > 0
        specs.append(F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.table_name).alias("table_name"),
            F.lit(r.column_name).alias("column_name"), F.lit(r.rule_type).alias("rule_type"),
            F.lit(r.severity).alias("severity"), failed.alias("failed_rows"),
            total.alias("total_rows"),
            F.when(bad, F.lit("FAILED")).otherwise(F.lit("PASSED")).alias("status")))
    return one.select(F.explode(F.array(*specs)).alias("r")).select(
        *[F.col(f"r.{c}").alias(c) for c in RESULT_COLUMNS])


def rules_from_frame(rules_df: DataFrame, max_rules: int = 10_000) -> list[Rule]:
    """Rules stored as a table (rule_id, column_name, rule_type, value as
    JSON text, severity, table_name). A rule set is configuration: it is
    read to the driver only after a bounded size check."""
    import json
    rows = rules_df.limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    out = []
    for r in rows:
        d = r.asDict()
        val = d.get("value")
        out.append(Rule(d["rule_id"], d["column_name"], d["rule_type"],
                        json.loads(val) if isinstance(val, str) and val else val,
                        d.get("severity") or "ERROR", d.get("table_name") or ""))
    return out
