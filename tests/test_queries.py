"""Every query with SQL against DuckDB on the smallest tables; the others by rows and columns."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace import catalogue

DIR = "/root/testdata/sf0.001"
SLOW = {"automl_binary", "linear_oof", "trees_oof", "role_stats", "blend_weights"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        numeric = pd.api.types.is_numeric_dtype(d[c]) and not pd.api.types.is_bool_dtype(d[c])
        d[c] = d[c].astype(float).round(5) if numeric else d[c].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
    return d.sort_values(list(d.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, con, name):
    got, want = plain(catalogue.QUERIES[name](spark, DIR).toPandas()), plain(con.execute(catalogue.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float and want[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=1e-6, atol=1e-5, equal_nan=True), c
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - SLOW))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0
