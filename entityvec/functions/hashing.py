"""Keyed hashes: the only source of randomness, so a re-run task draws the same values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: int | str, *keys: Column | str) -> Column:
    """md5 hex of ``seed|key|key``; also computable outside Spark."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_int(digest: Column) -> Column:
    """Unsigned 60-bit integer out of the first 15 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def draw(seed: int | str, purpose: str, *keys: Column | str) -> Column:
    """Reproducible non-negative integer for one purpose and key."""
    return hash_int(keyed_hash(f"{seed}|{purpose}", *keys))
