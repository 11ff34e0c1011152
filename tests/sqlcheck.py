"""Compares a query with its SQL on DuckDB."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(value, v))
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 6) if isinstance(v, numbers.Number) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


def database(sf=SF):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return con


def check(spark, query, sql, sf=SF):
    ours, theirs = query(spark, sf).toPandas(), database(sf).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
