"""Compare Spark results with DuckDB results, independent of row order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def duckdb_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _kind(value) -> str:
    """Value family, so that an INT never passes for a DECIMAL or a text."""
    if isinstance(value, bool):
        return "bool"
    for kind, types in {
        "int": int,
        "decimal": Decimal,
        "double": float,
        "timestamp": datetime,
        "date": date,
        "text": str,
    }.items():
        if isinstance(value, types):
            return kind
    return "null" if value is None else type(value).__name__


def _canonical(row) -> tuple:
    out = []
    for v in row:
        if isinstance(v, float):
            assert math.isfinite(v)
        out.append((_kind(v), v))
    return tuple(out)


def differences(df, con, sql: str) -> str | None:
    """``None`` when both sides hold the same columns and the same bag of rows."""
    names = sorted(df.columns)
    found = Counter(_canonical(r) for r in df.select(*names).collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns differ: {names} and {sorted(cols)}"
    order = [cols.index(n) for n in names]
    wanted = Counter(_canonical([r[i] for i in order]) for r in rel.fetchall())
    if found == wanted:
        return None
    extra, missing = found - wanted, wanted - found
    return (
        f"{found.total()} rows, {wanted.total()} wanted; "
        f"extra {list(extra)[:2]}; missing {list(missing)[:2]}"
    )
