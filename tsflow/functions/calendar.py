"""Calendar marks, scaled time features, frequency dispatch and sin/cos codes.

All features are built-in column arithmetic (no per-row Python).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(ts) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def weekday0(ts) -> Column:
    """Day of week with Monday = 0 (Spark ``weekday``)."""
    return F.weekday(_c(ts))


def calendar_mark_cols(ts, minute: bool = False) -> list[Column]:
    """Integer marks in the order month, day, weekday (Mon=0), hour[, minute div 15]."""
    t = _c(ts)
    cols = [F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
            weekday0(t).alias("weekday"), F.hour(t).alias("hour")]
    if minute:
        cols.append(F.floor(F.minute(t) / 15).cast("int").alias("minute"))
    return cols


# Scaled features in [-0.5, 0.5]; each maps a timestamp column to a double.
def _second_of_minute(t):
    return F.second(t) / 59.0 - 0.5


def _minute_of_hour(t):
    return F.minute(t) / 59.0 - 0.5


def _hour_of_day(t):
    return F.hour(t) / 23.0 - 0.5


def _day_of_week(t):
    return weekday0(t) / 6.0 - 0.5


def _day_of_month(t):
    return (F.dayofmonth(t) - 1) / 30.0 - 0.5


def _day_of_year(t):
    return (F.dayofyear(t) - 1) / 365.0 - 0.5


def _month_of_year(t):
    return (F.month(t) - 1) / 11.0 - 0.5


def _week_of_year(t):
    return (F.weekofyear(t) - 1) / 52.0 - 0.5  # ISO week


FEATURES = {
    "second_of_minute": _second_of_minute,
    "minute_of_hour": _minute_of_hour,
    "hour_of_day": _hour_of_day,
    "day_of_week": _day_of_week,
    "day_of_month": _day_of_month,
    "day_of_year": _day_of_year,
    "month_of_year": _month_of_year,
    "week_of_year": _week_of_year,
}

# Fixed values (must equal the reference): which features each base frequency gets, in order.
FREQ_FEATURES = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": ["day_of_week", "day_of_month", "day_of_year"],
    "B": ["day_of_week", "day_of_month", "day_of_year"],
    "H": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "T": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
}

# Accepted unit spellings (pandas offset aliases) -> base frequency.
UNIT_ALIASES = {
    "Y": "Y", "YE": "Y", "A": "Y", "y": "Y", "ye": "Y", "a": "Y",
    "Q": "Q", "QE": "Q", "q": "Q", "qe": "Q",
    "M": "M", "ME": "M", "m": "M", "me": "M",
    "W": "W", "w": "W",
    "D": "D", "d": "D",
    "B": "B", "b": "B",
    "H": "H", "h": "H",
    "T": "T", "min": "T", "t": "T",
    "S": "S", "s": "S",
}

_FREQ_RE = re.compile(r"^\s*(\d*)\s*([A-Za-z]+)(-[A-Za-z]{3})?\s*$")


def features_for_freq(freq: str) -> list[str]:
    """Feature names for a frequency string such as ``h``, ``15min``, ``3H``, ``W-SUN``.

    Raises ``ValueError`` for an unsupported frequency.
    """
    m = _FREQ_RE.match(freq or "")
    unit = m.group(2) if m else None
    if m and m.group(3) and unit not in ("W", "w", "Q", "q", "QE", "A", "Y", "YE"):
        unit = None
    base = UNIT_ALIASES.get(unit) if unit else None
    if base is None:
        raise ValueError(
            f"Unsupported frequency {freq!r}; supported: Y/A yearly, Q quarterly, M monthly, W weekly, "
            "D daily, B business days, H hourly, T/min minutely, S secondly (with an optional multiple)")
    return list(FREQ_FEATURES[base])


def time_feature_cols(ts, freq: str) -> list[Column]:
    t = _c(ts)
    return [FEATURES[name](t).alias(name) for name in features_for_freq(freq)]


_LN10000 = math.log(10000.0)


def sincos(pos: Column, d: int) -> Column:
    """Sinusoidal code of length ``d`` for integer position ``pos``: even slots sin, odd slots cos,
    slot j uses frequency exp(-(j - j%2) * ln(10000) / d)."""
    p = pos.cast("double")
    return F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(
            j % 2 == 0, F.sin(p * F.exp(-(j - j % 2).cast("double") * F.lit(_LN10000 / d)))
        ).otherwise(F.cos(p * F.exp(-(j - j % 2).cast("double") * F.lit(_LN10000 / d)))),
    )


def sincos_sum(cols: list[Column], d: int) -> Column:
    """Element-wise sum of the sin/cos codes of several integer columns (fixed temporal code)."""
    codes = [sincos(c, d) for c in cols]
    out = codes[0]
    for c in codes[1:]:
        out = F.zip_with(out, c, lambda a, b: a + b)
    return out


# DataFrame-level forms
def calendar_marks(df, ts: str, minute: bool = False):
    """Add integer marks month, day, weekday (Mon=0), hour[, minute div 15]."""
    return df.select("*", *calendar_mark_cols(ts, minute))


def time_features(df, ts: str, freq: str):
    """Add the scaled time features chosen by ``freq`` (raises ``ValueError`` when unsupported)."""
    return df.select("*", *time_feature_cols(ts, freq))


def sincos_calendar(df, ts: str, d: int, minute: bool = False, name: str = "temporal_code"):
    """Add the fixed temporal code: sum of sin/cos codes of hour, weekday, day, month[, minute div 15]."""
    t = F.col(ts)
    parts = [F.hour(t), F.weekday(t), F.dayofmonth(t), F.month(t)]
    if minute:
        parts.append(F.floor(F.minute(t) / 15).cast("int"))
    return df.withColumn(name, sincos_sum(parts, d))
