"""Every query of the core with SQL against DuckDB on the small tables, where these are present."""

import os

import duckdb
import pandas as pd
import pytest

from parsewright.plans import registry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(frame):
    names = sorted(frame.columns)
    clean = lambda v: None if pd.isna(v) else str(v) if isinstance(v, str) else bool(v) if isinstance(v, bool) else round(float(v), 6)
    return names, sorted(([clean(v) for v in r] for r in frame[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())
