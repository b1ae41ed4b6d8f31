"""Reproducible randomness: everything random is a function of md5(seed:key), never of partitions or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: str | Column) -> Column:
    """The md5 hex string of seed and keys joined by colons: an order that is the same on any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(h: Column, at: int = 1) -> Column:
    """A double in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(h, at, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sign(h: Column, at: int = 1) -> Column:
    """-1 or 1 from one hex digit."""
    return F.when(F.substring(h, at, 1) < "8", F.lit(-1.0)).otherwise(F.lit(1.0))


def normal(h: Column) -> Column:
    """Standard normal by Box and Muller from sixteen hex digits."""
    return F.sqrt(-2 * F.log(1 - uniform(h, 1))) * F.cos(2 * math.pi * uniform(h, 9))
