"""Driver contract: entry runs, every query has a callable, oracle spot checks."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

FAST = ["fact_mart", "dq_report", "date_dim", "product_dim", "region_lookup", "incident_choice",
        "lineage_closure", "rules_zscore", "schema_conform", "dedupe_composite"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "net_amount_inr" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_oracle_at_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)

    def bag(cols, rows):
        idx = sorted(range(len(cols)), key=lambda i: cols[i])
        return Counter(tuple(r[i] for i in idx) for r in rows)

    assert bag(df.columns, df.collect()) == bag(dcols, res.fetchall())
