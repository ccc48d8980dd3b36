"""The training-data queries over whole tables: against SQL where there is one, else shape and uniqueness."""

import glob
import os

import duckdb
import pytest

from quillsift.llm import catalog

DATA = os.environ.get("QUILLSIFT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p1_found": ["row_id", "field_name", "defect"], "p2_found": ["table_name", "row_id", "field_name"], "p3_found": ["cwe"], "p4_found": ["table_name", "row_id", "field_name"], "p5_found": ["pref_id_a", "pref_id_b"],
    "p6_found": ["row_id_a", "row_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    frame = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in frame.collect()]
    if name in COLUMNS:
        assert frame.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in catalog.ORACLES:
        c = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        want = c.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == sorted(frame.columns)
        assert sorted(map(str, rows)) == sorted(str(tuple(r[want.columns.index(x)] for x in frame.columns)) for r in want.fetchall())
