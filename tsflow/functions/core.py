"""Deterministic draws, safe division and array padding as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide_no_nan(a: Column, b: Column) -> Column:
    """a / b with NaN, +inf and division by zero mapped to 0 (ANSI-safe).

    ``try_divide`` gives null for b = 0, which we turn into 0.  A -inf result is
    mapped to 0 as well (documented difference: the reference lets -inf pass).
    """
    q = F.try_divide(a, b)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), F.lit(0.0)).otherwise(q)


def key_string(tag: str, seed: int, keys: Sequence[str]) -> Column:
    """The text hashed for a draw: ``tag|seed|k1|k2...``."""
    parts = [F.lit(tag), F.lit(str(seed))] + [F.col(k).cast("string") for k in keys]
    return F.concat_ws("|", *parts)


def hash_int(tag: str, seed: int, keys: Sequence[str]) -> Column:
    """First 32 bits of md5(tag|seed|keys) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(key_string(tag, seed, keys)), 1, 8), 16, 10).cast("bigint")


def hash_bucket(tag: str, seed: int, keys: Sequence[str], hex_digits: int = 3) -> Column:
    """Leading ``hex_digits`` of the same md5: a bucket consistent with ``hash_int`` order."""
    return F.conv(F.substring(F.md5(key_string(tag, seed, keys)), 1, hex_digits), 16, 10).cast("bigint")


def uniform_int(tag: str, seed: int, keys: Sequence[str], low: Column, high: Column) -> Column:
    """Seeded integer in [low, high) per key (null when the range is empty)."""
    span = high - low
    return F.when(span > 0, low + F.pmod(hash_int(tag, seed, keys), span.cast("bigint")))


def permuted(x: Column, n: Column, tag: str, seed: int, epoch: Column, rounds: int = 32) -> Column:
    """Place of ``x`` in a keyed permutation of [0, n), a different one for each epoch.

    Swap-or-not rounds: the pair ``x`` and ``key - x`` (mod n) swaps places if a hash of its greater member
    says so.  Each round maps [0, n) onto itself for any n, so no sort, no shuffle and no count per row is needed."""
    def digits(i: Column, what: Column, length: int) -> Column:
        text = F.concat_ws("|", F.lit(tag), F.lit(str(seed)), epoch.cast("string"), i.cast("string"), what.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, length), 16, 10).cast("bigint")

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(digits(i, F.lit("key"), 12) - at, n)
        return F.when(digits(i, F.greatest(at, other), 1) >= 8, other).otherwise(at)
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("bigint"), swap)


def pad_left(arr: Column, size: int, fill: float = 0.0) -> Column:
    """Right-align ``arr`` in ``size`` slots with ``fill`` on the left (arr must be <= size)."""
    n = F.greatest(F.lit(size) - F.size(arr), F.lit(0))
    return F.concat(F.array_repeat(F.lit(fill).cast("double"), n), arr)


def pad_right(arr: Column, size: int, fill: float = 0.0) -> Column:
    n = F.greatest(F.lit(size) - F.size(arr), F.lit(0))
    return F.concat(arr, F.array_repeat(F.lit(fill).cast("double"), n))
