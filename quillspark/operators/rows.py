"""Vectors of a column as numpy blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(points: DataFrame, x: str = "x") -> DataFrame:
    """Rows whose vector isn't null and holds no null: others take no part in any statistic or search."""
    return points.where(F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull()))


def doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def stacked(column: pd.Series) -> np.ndarray:
    """One vector per row; vectors of different lengths are an error."""
    rows = column.to_numpy()
    widths = {len(r) for r in rows}
    if len(widths) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(widths)[:5]}")
    return np.stack(rows).astype(np.float64)
