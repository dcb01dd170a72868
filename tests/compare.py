"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    kinds = {c: ("float" if frame[c].dtype.kind == "f" else "int" if frame[c].dtype.kind in "iu" else "other") for c in frame}
    frame = frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)
    frame.attrs["kinds"] = kinds
    return frame


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """First difference between two results without regard to order; None when they agree."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = _canonical(got), _canonical(want)
    if got.attrs["kinds"] != want.attrs["kinds"]:
        return f"types {got.dtypes.to_dict()} / {want.dtypes.to_dict()}"
    for column in got:
        a, b = got[column], want[column]
        differs = ~((a == b) | (a.isna() & b.isna()))
        if differs.any():
            i = differs.idxmax()
            return f"{column}: {int(differs.sum())} rows, first {got.loc[i].to_dict()} / {want.loc[i].to_dict()}"
    return None
