"""Small helpers for batches that go between the JVM and Python."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd


def frame(rows: Iterable[Sequence], columns: Sequence[str]) -> pd.DataFrame:
    """A batch of rows whose columns hold plain objects, so that Arrow takes each as one array."""
    rows = list(rows)
    cols = list(zip(*rows)) if rows else [()] * len(columns)
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, cols)})
