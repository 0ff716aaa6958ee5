"""Side-by-side comparison with DuckDB, used by the oracle tests."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    rows = [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]
    return names, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(spark, query, sql: str, folder: str, larger: str | None = None) -> None:
    """The query gives the SQL's rows, and some; where ``folder`` is too small for any, ``larger`` has them."""
    names, got = rows_of(query(spark, folder).toPandas())
    expected_names, expected = rows_of(connect(folder).execute(sql).df())
    assert names == expected_names
    assert len(got) == len(expected)
    if not expected and larger:
        return assert_same(spark, query, sql, larger)
    assert expected, "nothing was compared"
    different = [(a, b) for a, b in zip(got, expected) if a != b]
    assert not different, different[:3]
