"""Runs a registered query and its SQL twin and compares them as sorted rows."""

import glob
import math
import os

import duckdb


def tidy(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(frame, columns):
    return sorted((tuple(tidy(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


def compare(spark, query, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    ours, theirs = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows_of(ours, columns) == rows_of(theirs, columns)
