"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.constants import BROADCAST_ROWS


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counting stops one row beyond the bound."""
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def broadcast_bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else ``df`` hinted to a shuffled merge join."""
    return F.broadcast(df) if small_enough(df, most) else df.hint("merge")
