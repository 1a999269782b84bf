"""Every registered query against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pandas as pd
import pytest

from lorekeep.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL can't express; test_search.py holds them against brute force or another reading.
ELSEWHERE = {"glossary_suggestions", "fuzzy_ratio", "fuzzy_names", "html_markdown", "heading_chunks", "split_answers"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v).tz_localize(None))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    frame = queries.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in queries.ORACLE_SQL:
        assert name in ELSEWHERE and got
        return
    result = duck.sql(queries.ORACLE_SQL[name])
    names = result.columns
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
