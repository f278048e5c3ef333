"""Queries against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from weftline.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["log_returns", "forward_at_calendar", "market_return_vol", "correlated_pairs", "bh_fdr", "shock_gate_detail", "daily_news_signal", "flatten_announcement_json", "propose_edges", "resolve_exact"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    want = c.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [list(want.columns).index(k) for k in columns]
    assert sorted(str([r[k] for k in columns]) for r in df.collect()) == sorted(str([r[k] for k in order]) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
