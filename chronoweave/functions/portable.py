"""Hash-based random numbers that any engine reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 32


def hash_int(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """In [0, 1)."""
    return hash_int(*parts) / F.lit(float(TOP))


def normal(*parts: Column) -> Column:
    """Standard normal by Box and Muller."""
    u = (hash_int(*parts, F.lit("a")) + 1) / F.lit(float(TOP) + 1)
    v = uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
