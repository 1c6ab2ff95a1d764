"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quirelake.plans import ORACLE, QUERIES

from .conftest import SMALL


def rows(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_two_stage_recall(spark):
    large = "/root/testdata/sf0.1"
    hits = lambda name: {(r["query"], r["id"]) for r in QUERIES[name](spark, large).collect()}
    exact, found = hits("vector_topk_exact"), hits("vector_topk_two_stage")
    assert len(exact) == 20 * 100 and len(exact & found) >= 0.9 * len(exact)
