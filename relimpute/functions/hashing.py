"""Reproducible pseudo-randomness: every draw is a hash of (key, name, seed).

A draw needs no shuffle, does not depend on partitioning and is the same after a task is rerun.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, name: Column | str, seed: int) -> Column:
    """32 hex digits, uniform over (key, name, seed)."""
    label = F.lit(name) if isinstance(name, str) else name
    return F.md5(F.concat_ws(":", key.cast("string"), label, F.lit(str(seed))))


def bound(fraction: float) -> str:
    """The eight-digit prefix below which a draw falls with probability `fraction`."""
    return f"{int(fraction * 2**32):08x}"


def drawn(hashed: Column, fraction: float) -> Column:
    """True for the given fraction of draws."""
    if fraction >= 1:
        return F.lit(True)
    if fraction <= 0:
        return F.lit(False)
    return F.substring(hashed, 1, 8) < F.lit(bound(fraction))


def bucket_of(hashed: Column, buckets: Column | int) -> Column:
    """A draw as a whole number in [0, buckets)."""
    n = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))
