"""Deterministic pseudo-random numbers from row keys.

A hash of the key gives the same draw on every executor and on every retry, with
no generator state and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(*keys: Column) -> Column:
    """First 32 bits of the MD5 of the keys joined by `|`, as a BIGINT."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_unit(*keys: Column) -> Column:
    """The same hash scaled to [0, 1)."""
    return hash32(*keys) / F.lit(float(2 ** 32))
