"""Comparison of a registered query with its SQL."""

import os

import duckdb

from panelkit.llm import queries

TABLES = ("documents", "labels", "conversations")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in values)


def same_as_sql(spark, sf: str, name: str, glob: bool = False) -> None:
    """``glob``: tables are folders, as Spark writes them."""
    df = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if glob else ''}'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, told = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert len(got) == len(told)
    assert [a for a, b in zip(got, told) if a != b][:3] == [b for a, b in zip(got, told) if a != b][:3]
