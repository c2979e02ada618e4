"""Stable pseudo-random numbers from md5, identical in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def h32(*parts) -> Column:
    """First 8 hex digits of md5 of the ':'-joined parts, as BIGINT."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, 8), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """``h32`` scaled to [0, 1)."""
    return h32(*parts).cast("double") / F.lit(TWO_32)
