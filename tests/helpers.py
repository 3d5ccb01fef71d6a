"""Comparison of a query with the SQL that states its result."""

import glob
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def oracle(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from read_parquet('{path}')")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def plain(value):
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    """Rows as tuples in the order of column names, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str = SF) -> int:
    columns, expected = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got, want = canonical(df.columns, df.collect()), canonical(columns, expected)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got)
