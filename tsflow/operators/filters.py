"""Projections and filters: feature modes, long-group filter, wide -> long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_mode(df: DataFrame, mode: str, target: str, date: str = "date", keep: Sequence[str] = ()) -> DataFrame:
    """``S``: date + target only; ``M``/``MS``: date, every other channel, target last."""
    if mode == "S":
        return df.select(date, *keep, target)
    if mode in ("M", "MS"):
        others = [c for c in df.columns if c not in (date, target, *keep)]
        return df.select(date, *keep, *others, target)
    raise ValueError(f"unknown feature mode {mode!r}")


def keep_long(df: DataFrame, keys: Sequence[str], more_than: int, count_col: str | None = None,
              name: str = "n") -> DataFrame:
    """Rows of the groups with more than ``more_than`` rows (``count(count_col)`` counts non-null
    values).  Counts are a partial aggregate joined back; the count column is kept as ``name``."""
    keys = list(keys)
    cnt = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    lens = df.groupBy(*keys).agg(cnt.alias(name)).where(F.col(name) > more_than)
    return df.join(lens, on=keys)


def melt(df: DataFrame, keys: Sequence[str], channels: Sequence[str], channel: str = "channel",
         value: str = "value") -> DataFrame:
    """Wide -> long: one row per (keys, channel) -- channel-independent series."""
    return df.unpivot(list(keys), list(channels), channel, value)
