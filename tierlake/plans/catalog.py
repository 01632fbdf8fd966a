"""Query catalog on the driver's tables.

Each query maps a mart, check or incident operator onto the TPC-H-like test
tables. Messy inputs are produced by a deterministic projection of the real
tables (the same projection is written in SQL in ``plans.oracle``), so every
query reads whole tables and its work grows with them.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.operators import quality
from tierlake.operators.quality import Checks, findings
from tierlake.plans import marts
from tierlake.session import scratch_path
from tierlake.sources.scan import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _dec_text(c: Column, scale: int) -> Column:
    """Number as text through a decimal, so both engines print it alike."""
    return c.cast(f"decimal(18,{scale})").cast("string")


def _pad2(c: Column) -> Column:
    return F.lpad(_s(c), 2, "0")


# --------------------------------------------------------------------------
# Messy order items from lineitem (the raw CSV of the fact pipeline)
# --------------------------------------------------------------------------

CURRENCY_BY_SUPPLIER = ["INR", " usd ", "AED", "aud", "CAD ", "GBP", "sgd", "EUR"]


def raw_order_items(lineitem: DataFrame) -> DataFrame:
    """All-string order items with the dirty cases of the fact source."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    ship = F.col("l_shipdate")
    hh = _pad2((k * 7 + n) % 24)
    mi = _pad2((k * 13 + n * 3) % 60)
    ss = _pad2(p % 60)
    iso_ts = F.concat(F.date_format(ship, "yyyy-MM-dd"), F.lit(" "), hh, F.lit(":"), mi,
                      F.lit(":"), ss)
    dmy_ts = F.concat(F.date_format(ship, "dd-MM-yyyy"), F.lit(" "), hh, F.lit(":"), mi)
    qty = F.col("l_quantity")
    price = _dec_text(F.col("l_extendedprice"), 2)
    pct = _dec_text(F.col("l_discount") * 100, 2)
    tax = _dec_text(F.col("l_tax") * 100, 2)
    currency = F.element_at(F.array(*[F.lit(c) for c in CURRENCY_BY_SUPPLIER]),
                            (s % 8 + 1).cast("int"))
    return lineitem.select(
        F.when(n == 7, F.date_format(ship, "yyyy/MM/dd"))
         .otherwise(F.date_format(ship, "yyyy-MM-dd")).alias("dt"),
        F.when(p % 101 == 0, F.lit("not a time"))
         .when(k % 2 == 0, iso_ts).otherwise(dmy_ts).alias("order_ts"),
        _s(s).alias("customer_id"),
        _s(k).alias("order_id"),
        F.when(p % 211 == 0, F.lit(None).cast("string"))
         .when(p % 50 == 0, F.concat(F.lit("0"), _s(n))).otherwise(_s(n)).alias("item_seq"),
        _s(p).alias("product_id"),
        F.when(qty == 2, F.lit("Two"))
         .when(p % 13 == 0, _dec_text(qty, 1))
         .when(p % 97 == 0, F.lit("abc"))
         .when(p % 89 == 0, F.lit(None).cast("string"))
         .otherwise(_s(qty.cast("int"))).alias("quantity"),
        currency.alias("unit_price_currency"),
        F.when(n % 2 == 0, F.concat(F.lit("$"), price))
         .when(p % 53 == 0, F.regexp_replace(price, r"\.", ","))
         .otherwise(price).alias("unit_price"),
        F.when(n % 2 == 1, F.concat(pct, F.lit("%"))).otherwise(pct).alias("discount_pct"),
        F.when(k % 5 == 0, F.concat(F.lit("INR "), tax))
         .when(k % 7 == 0, F.concat(F.lit("-"), tax))
         .when(p % 31 == 0, F.lit("n/a"))
         .otherwise(tax).alias("tax_amount"),
        F.when(n % 3 == 0, F.lit("web")).when(n % 3 == 1, F.lit("app"))
         .otherwise(F.lit("Store")).alias("channel"),
        F.when(F.col("l_returnflag") == "R", F.lit(" SAVE10 "))
         .when(F.col("l_returnflag") == "A", F.lit(""))
         .otherwise(F.lit(None).cast("string")).alias("coupon_code"),
    )


def fact_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: silver order items (ordered de-duplication + column cleanups)."""
    raw = raw_order_items(table(spark, sf_dir, "lineitem"))
    return marts.silver_order_items(raw, order_by=[], audit=False)


def fact_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold order-item fact with INR amounts (flagship query)."""
    return marts.gold_order_items(fact_clean(spark, sf_dir), audit=False)


# --------------------------------------------------------------------------
# Quality checks (Q2-Q9) and bad rows (Q3)
# --------------------------------------------------------------------------

ITEM_KEYS = ("order_id", "item_seq")
SILVER_ITEM_CHECKS = Checks(keys=ITEM_KEYS, critical=("order_id", "product_id", "quantity",
                                                      "unit_price"), stage="silver")
GOLD_ITEM_CHECKS = Checks(metrics=("quantity", "net_amount", "net_amount_inr"), min_rows=10,
                          stage="gold")


def dq_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 + Q9 on a table that filters to nothing (shipments after 2100)."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2100-01-01").cast("timestamp"))
    return findings(li, Checks(metrics=("l_quantity",), min_rows=10, stage="gold"),
                    "lineitem_future")


def dq_min_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: orders expected to hold at least a billion rows."""
    return findings(table(spark, sf_dir, "orders"),
                    Checks(metrics=("o_totalprice",), min_rows=1_000_000_000, stage="gold"),
                    "orders")


def dq_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 (and Q3's count): rows of silver order items with a NULL key part."""
    return findings(fact_clean(spark, sf_dir), Checks(keys=ITEM_KEYS, duplicate_check=False),
                    "slv_order_items")


def dq_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: duplicate (l_orderkey, l_linenumber) groups of lineitem."""
    return findings(table(spark, sf_dir, "lineitem"),
                    Checks(keys=("l_orderkey", "l_linenumber")), "lineitem")


def dq_critical_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: NULLs in critical columns of silver order items."""
    return findings(fact_clean(spark, sf_dir),
                    Checks(critical=("order_id", "product_id", "quantity", "unit_price", "dt",
                                     "order_ts", "tax_amount", "discount_pct")),
                    "slv_order_items")


def dq_metric_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7 (+Q8): NULL and negative business metrics of the gold fact."""
    return findings(fact_mart(spark, sf_dir), GOLD_ITEM_CHECKS, "gld_fact_order_items")


def dq_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: negative account balances; the string metric is skipped."""
    return findings(table(spark, sf_dir, "customer"),
                    Checks(metrics=("c_acctbal", "c_name"), min_rows=5, stage="gold"),
                    "customer")


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the fact pipeline's stored tables in one findings frame.

    Silver is stored once (Parquet in the shared folder), then checked and
    enriched from the stored copy, as a pipeline run would: the dedupe and
    parsing are not computed twice, and each check reads only its columns.
    """
    path = scratch_path(spark, "dq_report")
    fact_clean(spark, sf_dir).write.parquet(path)
    silver = spark.read.parquet(path)
    gold = marts.gold_order_items(silver, audit=False)
    return (findings(silver, SILVER_ITEM_CHECKS, "slv_order_items")
            .unionByName(findings(gold, GOLD_ITEM_CHECKS, "gld_fact_order_items"))
            .unionByName(findings(table(spark, sf_dir, "orders"),
                                  Checks(keys=("o_orderkey",), critical=("o_custkey", "o_orderdate"),
                                         stage="silver"), "orders")))


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: every silver order item with a NULL key part (not capped)."""
    return quality.bad_rows(fact_clean(spark, sf_dir), ITEM_KEYS)


def split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid side of the split: items with a complete key."""
    valid, _ = quality.split_valid(fact_clean(spark, sf_dir), ITEM_KEYS)
    return valid


QUERIES = {
    "fact_clean": fact_clean,
    "fact_mart": fact_mart,
    "dq_empty": dq_empty,
    "dq_min_rows": dq_min_rows,
    "dq_null_key": dq_null_key,
    "dq_duplicate_keys": dq_duplicate_keys,
    "dq_critical_nulls": dq_critical_nulls,
    "dq_metric_nulls": dq_metric_nulls,
    "dq_negative": dq_negative,
    "dq_report": dq_report,
    "bad_rows": bad_rows,
    "split_valid": split_valid,
}
