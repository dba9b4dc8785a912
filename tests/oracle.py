"""Comparison of a query's rows with those of DuckDB over the same files."""

import os

import duckdb


def connect(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


def same_rows(ours, theirs):
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def plain(frame):
        return sorted(tuple("null" if v is None or v != v else str(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))

    assert plain(ours) == plain(theirs)
