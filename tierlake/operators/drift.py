"""Schema drift and schema contracts.

* ``schema_diff``     missing / extra / changed-type columns between two
                      schemas (column count is small: done on the driver)
* ``catalog_drift``   the same over many tables at once, as a DataFrame join
                      of two (table, column, type) frames
* ``nested_drift``    the same for what columns hold: fields of structs,
                      elements of arrays, keys and values of maps
* ``conform``         apply a schema contract with evolution rules, also
                      inside structs, arrays and maps
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, IntegralType, MapType, NumericType, StringType,
                               StructType)

DIFF_SCHEMA = ("column_name string, change string, expected_type string, "
               "actual_type string, compatible boolean")

_WIDTH = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def type_name(t: DataType) -> str:
    return t.simpleString()


def can_widen(actual: DataType, expected: DataType) -> bool:
    """True when values of ``actual`` fit ``expected`` without loss of kind:
    anything into string, a narrower number into a wider one."""
    if isinstance(expected, StringType) or actual == expected:
        return True
    if isinstance(actual, NumericType) and isinstance(expected, NumericType):
        a, e = _WIDTH.get(type_name(actual)), _WIDTH.get(type_name(expected))
        return a is not None and e is not None and a <= e
    return False


def schema_diff(expected: StructType, actual: StructType) -> list[tuple]:
    """Rows (column_name, change, expected_type, actual_type, compatible).

    change is 'missing' (expected, not present), 'extra' (present, not
    expected) or 'type_change'. Names compare case-sensitively. Empty list:
    no drift.
    """
    exp = {f.name: f.dataType for f in expected.fields}
    act = {f.name: f.dataType for f in actual.fields}
    rows = []
    for name, t in exp.items():
        if name not in act:
            rows.append((name, "missing", type_name(t), None, False))
        elif type_name(act[name]) != type_name(t):
            rows.append((name, "type_change", type_name(t), type_name(act[name]),
                         can_widen(act[name], t)))
    for name, t in act.items():
        if name not in exp:
            rows.append((name, "extra", None, type_name(t), True))
    return rows


def schema_diff_df(spark: SparkSession, expected: StructType, actual: StructType) -> DataFrame:
    return spark.createDataFrame(schema_diff(expected, actual), DIFF_SCHEMA)


def schema_frame(spark: SparkSession, schemas: dict[str, StructType]) -> DataFrame:
    """(table_name, column_name, data_type) rows for a set of schemas."""
    rows = [(t, f.name, type_name(f.dataType)) for t, s in schemas.items() for f in s.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def catalog_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Drift of many tables: full outer join of two (table_name,
    column_name, data_type) frames; one row per differing column."""
    e = expected.select("table_name", "column_name", F.col("data_type").alias("expected_type"))
    a = actual.select("table_name", "column_name", F.col("data_type").alias("actual_type"))
    j = e.join(a, ["table_name", "column_name"], "full_outer")
    change = (F.when(F.col("actual_type").isNull(), F.lit("missing"))
              .when(F.col("expected_type").isNull(), F.lit("extra"))
              .when(F.col("expected_type") != F.col("actual_type"), F.lit("type_change")))
    return j.withColumn("change", change).where(F.col("change").isNotNull())


def _path_name(name: str) -> str:
    return name if re.fullmatch(r"\w+", name) else "`" + name.replace("`", "``") + "`"


def schema_paths(t: DataType, path: str | None = None, parent: str | None = None) -> Iterator[tuple]:
    """(path, parent path, type) of every column and of what it holds:
    ``a.b`` is a field of a struct, ``a[]`` the element of an array, ``a{key}``
    and ``a{}`` the key and the value of a map. A container's type is only its
    kind, so a change inside it shows at its own path. Names that aren't plain
    words stand in backticks."""
    held: dict[str, DataType] = {}
    kind = type_name(t)
    if isinstance(t, StructType):
        kind = "struct"
        held = {f"{path}.{_path_name(f.name)}" if path else _path_name(f.name): f.dataType for f in t.fields}
    elif isinstance(t, ArrayType):
        kind, held = "array", {f"{path}[]": t.elementType}
    elif isinstance(t, MapType):
        kind, held = "map", {f"{path}{{key}}": t.keyType, f"{path}{{}}": t.valueType}
    if path:
        yield path, parent, kind
    for name, inner in held.items():
        yield from schema_paths(inner, name, path)


def path_frame(spark: SparkSession, schemas: dict[str, StructType]) -> DataFrame:
    """(table_name, column_name, parent, data_type): a row for each path."""
    rows = [(t, *one) for t, s in schemas.items() for one in schema_paths(s)]
    return spark.createDataFrame(rows, "table_name string, column_name string, parent string, data_type string")


def nested_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Drift of many tables at every path: ``catalog_drift`` of two
    ``path_frame``s. What lies below a path that drifted itself (a missing
    struct, an array that became a text) isn't reported again."""
    found = catalog_drift(expected, actual)
    parents = expected.select("table_name", "column_name", "parent").unionByName(
        actual.select("table_name", "column_name", "parent")).distinct()
    drifted = found.select("table_name", F.col("column_name").alias("parent"))
    below = parents.join(drifted, ["table_name", "parent"], "left_semi").select("table_name", "column_name")
    return found.join(below, ["table_name", "column_name"], "left_anti")


@dataclass(frozen=True)
class EvolutionRules:
    allow_new_columns: bool = True
    allow_missing_columns: bool = True
    auto_cast_types: bool = True
    strict_mode: bool = False


class SchemaContractError(ValueError):
    pass


def _lenient_cast(col, src: DataType, dst: DataType):
    """``col`` as ``dst``, NULL where it doesn't fit (ANSI on or off). Text
    becomes a whole number through an exact decimal, cut towards zero, so
    '2.7' is 2 for every width and a value out of range is NULL."""
    if src == dst:
        return col
    if isinstance(src, StringType) and isinstance(dst, IntegralType):
        whole = F.regexp_extract(col, r"^\s*([+-]?\d+)(\.\d*)?\s*$", 1)
        return F.when(whole != "", whole).try_cast("decimal(38,0)").try_cast(dst)
    if isinstance(src, StringType) and isinstance(dst, NumericType):
        return F.trim(col).try_cast(dst)
    return col.try_cast(dst)


def _fit(col: Column, src: DataType, dst: DataType, rules: EvolutionRules, path: str) -> Column:
    """``col`` as ``dst``: structs by the names of their fields, arrays and
    maps by what they hold, other types by a lenient cast."""
    if type_name(src) == type_name(dst):
        return col
    if isinstance(src, StructType) and isinstance(dst, StructType):
        fields = _fit_fields(src, dst, rules, col.getField, f"{path}.")
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(src, ArrayType) and isinstance(dst, ArrayType):
        return F.transform(col, lambda x: _fit(x, src.elementType, dst.elementType, rules, f"{path}[]"))
    if isinstance(src, MapType) and isinstance(dst, MapType) and (
            type_name(src.keyType) == type_name(dst.keyType)
            or rules.auto_cast_types and can_widen(src.keyType, dst.keyType)):
        if type_name(src.keyType) != type_name(dst.keyType):
            col = F.transform_keys(col, lambda k, _: k.cast(dst.keyType))
        return F.transform_values(col, lambda _, v: _fit(v, src.valueType, dst.valueType, rules, f"{path}{{}}"))
    if not rules.auto_cast_types:
        if rules.strict_mode:
            raise SchemaContractError(f"column {path}: {type_name(src)} is not {type_name(dst)}")
        return col
    containers = (StructType, ArrayType, MapType)
    if isinstance(dst, containers) or isinstance(src, containers) and not isinstance(dst, StringType):
        raise SchemaContractError(f"column {path}: {type_name(src)} can't become {type_name(dst)}")
    return _lenient_cast(col, src, dst)


def _fit_fields(have: StructType, want: StructType, rules: EvolutionRules,
                get: Callable[[str], Column], path: str = "") -> list[Column]:
    """The fields of ``want`` from those of ``have``, in order."""
    types = {f.name: f.dataType for f in have.fields}
    names = set(want.fieldNames())
    missing = [path + n for n in want.fieldNames() if n not in types]
    extra = [n for n in types if n not in names]
    if missing and (rules.strict_mode or not rules.allow_missing_columns):
        raise SchemaContractError(f"missing columns: {missing}")
    if extra and rules.strict_mode and not rules.allow_new_columns:
        raise SchemaContractError(f"unexpected columns: {[path + n for n in extra]}")
    cols = [_fit(get(f.name), types[f.name], f.dataType, rules, path + f.name).alias(f.name) if f.name in types
            else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
    return cols + [get(n).alias(n) for n in extra if rules.allow_new_columns]


def conform(df: DataFrame, contract: StructType, rules: EvolutionRules = EvolutionRules()) -> DataFrame:
    """Select the contract's columns by name, in contract order.

    missing column: NULL of the contract type (error when strict or not
    allowed); mismatched type: lenient cast when ``auto_cast_types`` (error
    when strict without it); extra columns: kept after the contract columns
    when allowed, else dropped (error when strict).

    The same holds inside structs (fields by name, a NULL struct stays NULL),
    for the elements of arrays and the values of maps. Keys of maps are only
    widened, so no two of them become one. A container that the contract has
    as another kind is an error, except as text.
    """
    return df.select(*_fit_fields(df.schema, contract, rules, lambda n: F.col(f"`{n.replace('`', '``')}`")))
