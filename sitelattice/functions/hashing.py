"""Hash-based randomness: a draw depends on ids and a seed, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *ids) -> Column:
    """md5 of ``seed|id|id...`` as 32 hex digits."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hex_fraction(h: Column, start: int = 1, digits: int = 8) -> Column:
    """Uniform value in [0, 1) from ``digits`` hex digits of a digest (1-based start)."""
    return F.conv(F.substring(h, start, digits), 16, 10).cast("double") / float(16**digits)


def uniform(seed, *ids) -> Column:
    return hex_fraction(digest(seed, *ids))


def gaussian(seed, *ids) -> Column:
    """Standard normal by Box-Muller from two independent slices of one digest."""
    h = digest(seed, *ids)
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1.0) / float(16**8 + 1)
    u2 = hex_fraction(h, 9, 8)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(u2 * 6.283185307179586)
