"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from affinis.plans import composite, details  # noqa: F401
from affinis.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    assert len(got) or name in ("leakage_check",)
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns)
    key = [c for c in columns if not pd.api.types.is_float_dtype(got[c])] or columns
    got, want = (x[columns].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if pd.api.types.is_float_dtype(got[c]):
            assert np.allclose(got[c], want[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
