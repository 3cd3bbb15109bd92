import os

import duckdb
import pytest

from textloom.llm.queries import QUERIES, SQL
from textloom.util import table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = sorted(map(tuple, QUERIES[name](spark, data).collect()))
    assert len(QUERIES[name](spark, data).columns) >= 1
    if name in SQL:
        con = duckdb.connect()
        for t in os.listdir(data):
            con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{data}/{t}'")
        assert got == sorted(con.execute(SQL[name]).fetchall())


def test_canonical_form_of_all_values(spark, data):
    got = {(r.kind, r.id) for r in QUERIES["p2_canonical"](spark, data).collect()}
    lines = {("line", r[0]) for r in table(spark, data, "encode_lines").where("text is not null").select("line_id").collect()}
    configs = {("config", r[0]) for r in table(spark, data, "special_configs").where("normalizer is not null").select("config_id").collect()}
    assert lines and configs and got == lines | configs
