"""Entity splits and entity samples with exact sizes."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityvec.functions.hashing import keyed_hash
from entityvec.functions.scratch import written
from entityvec.operators.entities import drop_singletons
from entityvec.operators.ranking import hash_cuts, take_by_hash


def check_ratios(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0 or max(train, val, test) > 1:
        raise ValueError("each ratio must lie between 0 and 1")
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {train + val + test}")


def split_of(entities: DataFrame, entity: str, seed: int = 42, train: float = 0.7,
             val: float = 0.15, test: float = 0.15) -> Column:
    """Split of an entity as an expression of its id alone.

    ``entities`` holds each entity once and is read twice. Two cut points in hash order are looked up, after
    which every row knows its split without a join: sizes are ``int(n*train)``,
    ``int(n*val)`` and the rest.
    """
    check_ratios(train, val, test)

    def bounds(n: int) -> list[int]:
        first = int(n * train)
        return [first, first + int(n * val)]

    _, (a, b) = hash_cuts(entities, entity, seed, bounds)
    key = F.col(entity)
    return (F.when(a.covers(seed, key), "train").when(b.covers(seed, key), "val")
            .otherwise("test"))


def assign_splits(entities: DataFrame, entity: str, seed: int = 42, train: float = 0.7,
                  val: float = 0.15, test: float = 0.15) -> DataFrame:
    """(entity, split) for every entity; the entities are read once."""
    entities = written(entities.select(entity), "entities")
    return entities.select(entity, split_of(entities, entity, seed, train, val, test)
                           .alias("split"))


def attach_split(rows: DataFrame, split_map: DataFrame, entity: str) -> DataFrame:
    """Look the split up; entities that the map lacks go to ``test``."""
    return (rows.join(split_map.select(entity, "split"), entity, "left")
            .withColumn("split", F.coalesce("split", F.lit("test"))))


def sample_entities(df: DataFrame, entity: str, n: int | None = None,
                    fraction: float | None = None, seed: int = 42) -> DataFrame:
    """All rows of a sample of entities; ``n`` (if > 0) wins over ``fraction`` (if < 1)."""
    if n is not None and n > 0:
        def size(total: int) -> int:
            return min(n, total)
    elif fraction is not None and fraction < 1.0:
        def size(total: int) -> int:
            return max(1, int(total * fraction))
    else:
        return df
    keys = written(df.select(entity).distinct(), "entities")
    _, (cut,) = hash_cuts(keys, entity, seed,
                          lambda total: [size(total)])
    # The choice depends on the id only: a plain filter, no join.
    return df.filter(cut.covers(seed, F.col(entity)))


def per_entity_head(df: DataFrame, entity: str, order: str | Sequence[str],
                    limit: int = 4) -> DataFrame:
    """First ``limit`` rows of each entity that has at least two; 0 means all its rows."""
    if limit <= 0:
        return drop_singletons(df, entity)
    keys = [order] if isinstance(order, str) else list(order)
    by_entity = Window.partitionBy(entity)
    keep = max(limit, 2)
    # The rank filter is applied per task before the shuffle, which tames hot entities.
    return (df.withColumn("_rn", F.row_number().over(by_entity.orderBy(*keys)))
            .filter(F.col("_rn") <= keep)
            .withColumn("_n", F.count(F.lit(1)).over(by_entity))
            .filter((F.col("_n") >= 2) & (F.col("_rn") <= limit))
            .drop("_rn", "_n"))


def cap_queries(df: DataFrame, key: str, maximum: int = 512, seed: int = 0) -> DataFrame:
    """Random ``maximum`` rows (a top-k over the hash order); 0 means all."""
    if maximum <= 0:
        return df
    return df.orderBy(keyed_hash(seed, key), key).limit(maximum)


def calibration_size(total: int, fraction: float, minimum: int = 10_000) -> int:
    return min(total, max(math.ceil(total * fraction), minimum))


def calibration_sample(anchors: DataFrame, key: str, fraction: float = 0.03,
                       seed: int = 42, minimum: int = 10_000) -> DataFrame:
    """Anchors that calibrate the bands, drawn without replacement."""
    return take_by_hash(anchors, key, seed,
                        lambda n: calibration_size(n, fraction, minimum))[0]
