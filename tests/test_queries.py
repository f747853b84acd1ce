"""Every query with an oracle against DuckDB on the smallest tables; plans of reports hold no Python."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from paperlark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    plain = lambda x: repr(round(float(x), 9)) if isinstance(x, float) else str(x.item() if hasattr(x, "item") else x)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    ours = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    theirs = con.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["product_summaries", "unmatched_items", "fuzzy_match", "receipt_parse", "keyword_category"])
def test_stays_in_the_jvm(spark, name):
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only_queries(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
