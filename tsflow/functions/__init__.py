"""Column-level helpers: everything here returns a ``Column`` and stays JVM-side."""

from tsflow.functions.core import (  # noqa: F401
    divide_no_nan, hash_int, hash_bucket, key_string, uniform_int, pad_left, pad_right,
)
from tsflow.functions.calendar import (  # noqa: F401
    calendar_mark_cols, time_feature_cols, features_for_freq, sincos,
)
