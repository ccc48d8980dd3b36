"""Every core query against its SQL, and plans of the main ones."""

import datetime
import glob
import os

import duckdb
import pytest

from quillsift.plans import catalog

DATA = os.environ.get("QUILLSIFT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        place = [want.columns.index(c) for c in columns]
        assert got == sorted(tuple(norm(r[k]) for k in place) for r in want.fetchall())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(catalog.QUERIES["q_lang_filter"](spark, DATA))
    assert "ReadSchema: struct<row_id:bigint,lang:string>" in text and "Exchange" not in text


def test_summary_aggregates_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["q_case_summary"](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_" in text


def test_conversion_needs_no_python(spark):
    assert "Python" not in plan(catalog.QUERIES["q_pref_projection"](spark, DATA))
