"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from reprise import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 5))
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def _rows(df):
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_without_corpus_part(monkeypatch):
    """The registry stands without the optional part."""
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("reprise.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "reprise.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "TMP-01" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
