"""Comparing Spark results with DuckDB and with plain Python."""

import datetime as dt
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
UTC = dt.timezone.utc


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def views(path: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(path):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{path}/{t}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows as comparable values, in any order, columns by name."""

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, (bool,)):
            return str(float(x))
        try:
            return repr(float(x))
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None))


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)
