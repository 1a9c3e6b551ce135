"""Rows of a Spark query against those of its SQL twin in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata/sf0.001")


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


def same(spark, query, sql: str, folder: Path = TESTDATA) -> None:
    with duckdb.connect() as con:
        for table in folder.glob("*.parquet"):
            con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
        told = con.execute(sql)
        names = [d[0] for d in told.description]
        want = rows_of(names, told.fetchall())
    df = query(spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
