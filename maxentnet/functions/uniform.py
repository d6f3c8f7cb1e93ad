"""Uniform numbers in [0, 1) by hashing: the same for the same keys and seed, however rows are dealt to partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str, salt: str = "", portable: bool = False) -> Column:
    """``portable`` takes 52 bits of an MD5 that any SQL engine can repeat; otherwise 53 bits of a faster hash."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    if portable:
        text = F.concat_ws("|", F.lit(f"{seed}{salt}"), *(c.cast("string") for c in cols))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}{salt}"), *cols), 11) / F.lit(float(1 << 53))
