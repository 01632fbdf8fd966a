"""Column expressions for cleaning messy values.

All parsing is lenient and independent of ``spark.sql.ansi.enabled``: a value
that does not parse becomes NULL (a quality check reports it later) instead
of failing the job. Every helper returns a Column and stays inside
whole-stage codegen; there are no UDFs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# A plain decimal number: optional sign, digits, optional fraction.
INT_TEXT = r"^\s*[+-]?\d+(\.\d*)?\s*$"
# A decimal number with optional exponent.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: ColumnOrName) -> Column:
    """Text to int like the non-ANSI cast: '2.0' -> 2, '2.7' -> 2, junk -> NULL.

    Out-of-range values become NULL.
    """
    c = _col(c)
    return F.when(
        c.cast("string").rlike(INT_TEXT),
        c.cast("string").try_cast("double").try_cast("int"),
    )


def to_double(c: ColumnOrName) -> Column:
    """Text to double; anything that is not a plain number is NULL."""
    c = _col(c)
    return F.when(c.cast("string").rlike(NUMBER_TEXT), c.cast("string").try_cast("double"))


def to_float(c: ColumnOrName) -> Column:
    """Text to float; anything that is not a plain number is NULL."""
    return to_double(c).cast("float")


def strip(c: ColumnOrName, pattern: str) -> Column:
    """Remove every match of ``pattern`` (all matches, not just the first)."""
    return F.regexp_replace(_col(c), pattern, "")


def parse_date(c: ColumnOrName, *formats: str) -> Column:
    """First format that parses wins; none gives NULL."""
    c = _col(c)
    parts = [F.try_to_date(c, f) for f in formats]
    return parts[0] if len(parts) == 1 else F.coalesce(*parts)


def parse_ts(c: ColumnOrName, *formats: str) -> Column:
    """First format that parses wins; none gives NULL."""
    c = _col(c)
    parts = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return parts[0] if len(parts) == 1 else F.coalesce(*parts)


def map_values(c: ColumnOrName, mapping: Mapping[str, object]) -> Column:
    """Exact-match value mapping; unmapped values (and NULL) pass through."""
    c = _col(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None
               else out.when(c == F.lit(k), F.lit(v)))
    return c if out is None else out.otherwise(c)


def presence_flag(c: ColumnOrName) -> Column:
    """1 when the value is present (a blank string counts), else 0."""
    return F.when(_col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))


def nonneg_or_zero(c: ColumnOrName) -> Column:
    """abs(value), NULL becomes 0."""
    c = _col(c)
    return F.when(c.isNotNull(), F.abs(c)).otherwise(F.lit(0))


def period_label(prefix: str, number: ColumnOrName, year: ColumnOrName) -> Column:
    """'Q3-2025' style label. A missing part gives '' (never NULL)."""
    return F.concat_ws("", F.concat(F.lit(prefix), _col(number), F.lit("-"), _col(year)))


def date_id(c: ColumnOrName) -> Column:
    """yyyyMMdd as int; NULL date gives NULL."""
    return F.date_format(_col(c), "yyyyMMdd").cast("int")


def month_name(c: ColumnOrName) -> Column:
    return F.date_format(_col(c), "MMMM")


def any_null(cols: list[str]) -> Column:
    """True when any of the columns is NULL."""
    pred = None
    for name in cols:
        p = F.col(name).isNull()
        pred = p if pred is None else (pred | p)
    return pred if pred is not None else F.lit(False)


def normalize_code(c: ColumnOrName) -> Column:
    """upper(trim(value)), used to match codes against lookups."""
    return F.upper(F.trim(_col(c)))
