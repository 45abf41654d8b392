"""Compare a registered query with its SQL on the same tables."""

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows_of(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    values = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in columns]
    return columns, sorted(tuple(_canon(x) for x in r) for r in zip(*values))


def compare(spark, sf_dir: str, query, sql: str) -> tuple[int, str | None]:
    """(rows, difference or None)."""
    got_columns, got = rows_of(query(spark, sf_dir).toPandas())
    want_columns, want = rows_of(connection(sf_dir).sql(sql).df())
    if got_columns != want_columns:
        return len(got), f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"{a} != {b}"
    return len(got), None
