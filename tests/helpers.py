"""Comparison of query results."""

from __future__ import annotations

import numpy as np
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows of a frame, columns by name, numbers rounded, in a fixed order."""

    def plain(v: object) -> object:
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return int(v)
        if isinstance(v, (int, np.integer)):
            return int(v)
        return round(float(v), 5) if isinstance(v, (float, np.floating)) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []
