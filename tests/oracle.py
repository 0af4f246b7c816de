"""Runs registered queries beside their DuckDB SQL and compares all rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows, whatever their order."""
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in columns if got[c].dtype.kind != want[c].dtype.kind}
    if kinds and len(got):
        return f"types {kinds}"
    text = lambda df: df[columns].map(lambda v: "null" if v is None or v is pd.NaT or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v))
    a, b = (text(x).apply("|".join, axis=1).sort_values(ignore_index=True) if len(x) else pd.Series(dtype=str) for x in (got, want))
    wrong = a != b if len(a) else a
    return f"{int(wrong.sum())} rows differ, such as {a[wrong].iloc[0]} against {b[wrong].iloc[0]}" if len(a) and wrong.any() else ""
