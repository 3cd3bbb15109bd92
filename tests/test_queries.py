import os

import duckdb
import pandas as pd
import pytest

from textloom.operators.tokenizer import TOKENIZERS
from textloom.plans import registry

QUERIES = registry.queries()
SQL = registry.oracle_sql() if os.path.isfile(f"{TOKENIZERS}/byte_bpe_50k.json") else {}


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda x: "null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(float(x)) if isinstance(x, int) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else show(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


@pytest.mark.skipif(not SQL, reason="no public tokenizer files")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in SQL:
        wanted = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert rows(got) == rows(wanted)


def test_scans_read_what_they_need(spark, data):
    plan = QUERIES["document_index"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text_id:bigint,path:string,tokens:array<bigint>>" in plan
    plan = QUERIES["word_freq"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan


@pytest.mark.parametrize("name", ["files_by_size", "files_by_path"])
def test_whole_listing_in_order(spark, data, duck, name):
    got = [tuple(r) for r in QUERIES[name](spark, data).collect()]
    assert len(got) > 100 and got == duck.execute(SQL[name]).fetchall()
