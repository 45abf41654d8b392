"""Filters by key set: exclusions, coverage and pending work. All equi joins.

No side is forced to be broadcast: adaptive execution broadcasts a side whose measured
size is small and otherwise splits hot keys of the sort-merge join.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Archives known to be damaged.
DAMAGED_ARCHIVES = (4, 30, 70, 72, 75, 80, 81, 84, 97)


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def exclude_sources(df: DataFrame, shard: Column,
                    blocklist: Sequence[int] = DAMAGED_ARCHIVES) -> DataFrame:
    """Drop rows of blocked shards; rows without a shard id stay."""
    blocked = F.coalesce(shard.isin([int(b) for b in blocklist]), F.lit(False))
    return df.filter(~blocked)


def missing_outputs(inputs: DataFrame, outputs: DataFrame, on: str) -> DataFrame:
    """Input keys for which no output exists, each once."""
    return inputs.select(on).distinct().join(outputs.select(on), on, "left_anti")


def pending_work(inputs: DataFrame, outputs: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inputs that still have to be processed, compared stem with stem."""
    keys = [on] if isinstance(on, str) else list(on)
    return inputs.join(outputs.select(*keys), keys, "left_anti")
