"""Types of text columns as an aggregate, for loads that read their files once.

A discovery read infers a schema by an own pass over the raw files. Here the
load itself counts, per column, how many texts parse as each type; the counts
of parts add up, so they ride on the load's write as an observation, and the
schema follows from them:

    every text parses as int -> integer; else long; else, for whole numbers,
    decimal of their digits; else double; else date (yyyy-MM-dd); dates and
    timestamps -> timestamp; true/false -> boolean; else, or without any
    text, string.

That is the result of CSV schema inference over the same texts, except where
inference depends on the order of rows: years (``2024``) among timestamps count
as timestamps here whatever comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType, TimestampType)

from tierlake.operators.drift import EvolutionRules, conform

# How the counted types are written as text. NUMBER is every text
# that a cast to double may take; others aren't tried, since a failed try is an
# exception.
WHOLE, DATE, TRUTH = r"^[+-]?\d+\z", r"^\d{4}-\d{2}-\d{2}\z", r"(?i)^(true|false)\z"
NUMBER = (r"^[\x00-\x20]*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?"
          r"|0[xX][0-9a-fA-F.]+[pP][+-]?\d+[fFdD]?|(?i:nan|inf|infinity))[\x00-\x20]*$")
COUNTS = ("texts", "ints", "longs", "wholes", "doubles", "dates", "times", "truths", "digits")
# The bit of each count in a cell's marks; the digits stand above them.
BITS = {name: 1 << i for i, name in enumerate(COUNTS[:-1])}
DIGITS = 1 << len(BITS)
MARKS = "__marks"


def cell_marks(c: Column) -> Column:
    """What the text of a cell parses as, in one number (NULL: no text). Whole
    numbers of few digits fit their type without a try."""
    digits = F.length(F.ltrim(F.ltrim(c, F.lit("+-")), F.lit("0")))

    def fits(most: int, kind: str) -> Column:
        return (digits <= most) | (digits == most + 1) & c.try_cast(kind).isNotNull()

    def mark(name: str, holds: Column) -> Column:
        return F.when(holds, F.lit(BITS[name])).otherwise(F.lit(0))

    time = mark("times", c.try_cast("timestamp").isNotNull())
    whole = (F.lit(BITS["texts"] + BITS["wholes"] + BITS["doubles"]) + time + digits * F.lit(DIGITS)
             + F.when(fits(9, "int"), F.lit(BITS["ints"] + BITS["longs"]))
             .when(fits(18, "bigint"), F.lit(BITS["longs"])).otherwise(F.lit(0)))
    # No two of these hold for one text.
    other = (F.when(c.rlike(NUMBER) & c.try_cast("double").isNotNull(), F.lit(BITS["doubles"]))
             .when((F.length(c) == 10) & c.rlike(DATE) & c.try_cast("date").isNotNull(), F.lit(BITS["dates"]))
             .when((F.length(c) <= 5) & c.rlike(TRUTH), F.lit(BITS["truths"])).otherwise(F.lit(0)))
    return F.when(c != "", F.when(c.rlike(WHOLE), whole).otherwise(F.lit(BITS["texts"]) + time + other))


def column_counts(m: Column, prefix: str) -> list[Column]:
    """The counts of one column of marks, named ``<prefix>_<count>``."""
    found = {name: F.sum(F.shiftright(m, i).bitwiseAND(F.lit(1))) for i, name in enumerate(BITS)}
    found["digits"] = F.max(F.shiftright(m, len(BITS)))
    return [F.coalesce(found[n], F.lit(0)).cast("bigint").alias(f"{prefix}_{n}") for n in COUNTS]


def type_of(n: dict[str, int]) -> DataType:
    """The type that holds every counted text."""
    texts = n["texts"]
    if not texts:
        return StringType()
    for name, kind in (("ints", IntegerType()), ("longs", LongType())):
        if n[name] == texts:
            return kind
    if n["wholes"] == texts and n["digits"] <= DecimalType(38, 0).precision:
        return DecimalType(max(n["digits"], 1), 0)
    for name, kind in (("doubles", DoubleType()), ("dates", DateType()), ("times", TimestampType()),
                       ("truths", BooleanType())):
        if n[name] == texts:
            return kind
    return StringType()


def observe_types(texts: DataFrame, seen: Observation) -> DataFrame:
    """``texts``, counted by whatever reads them. The cells of a row are marked
    as one array: an expression for each column would be more code than the
    JVM compiles."""
    cells = F.array(*[F.col(f"`{c}`") for c in texts.columns])
    marks = F.transform(cells, cell_marks)
    counted = texts.withColumn(MARKS, marks).observe(
        seen, *[x for i in range(len(texts.columns)) for x in column_counts(F.col(MARKS)[i], f"c{i}")])
    return counted.drop(MARKS)


def schema_of(columns: list[str], counts: dict[str, int]) -> StructType:
    return StructType([StructField(c, type_of({n: counts[f"c{i}_{n}"] for n in COUNTS}))
                       for i, c in enumerate(columns)])


def read_texts(spark: SparkSession, path: str, delimiter: str = ",", options: dict[str, str] | None = None) -> DataFrame:
    """All columns of CSV files as texts, named by their header (of which
    one line is read)."""
    return (spark.read.options(header=True, inferSchema=False, delimiter=delimiter, **(options or {}))
            .csv(path))


def load_observed(spark: SparkSession, path: str, target: str, declared: StructType | None = None,
                  delimiter: str = ",", options: dict[str, str] | None = None,
                  fmt: str = "parquet") -> StructType:
    """Load CSV files into ``target`` and return the schema that their texts
    have, from one read of them. With ``declared`` the stored table has those
    columns, bound by name with lenient casts; without it, the texts."""
    texts = read_texts(spark, path, delimiter, options)
    seen = Observation()
    rows = observe_types(texts, seen)
    if declared is not None:
        rows = conform(rows, declared, EvolutionRules(
            allow_new_columns=False, allow_missing_columns=True, auto_cast_types=True, strict_mode=False))
    rows.write.mode("overwrite").format(fmt).save(target)
    return schema_of(texts.columns, seen.get)
