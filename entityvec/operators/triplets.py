"""Anchor, positive and negative draws, triplet loss and the band bandit.

Every draw is a hash of (seed, purpose, draw number), so a lost task repeats its draws.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityvec.functions.hashing import draw, keyed_hash
from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import written
from entityvec.functions.schema import require_columns
from entityvec.functions.vectors import cosine_distance, euclidean
from entityvec.operators.entities import valid_entities
from entityvec.operators.ranking import dense_rank_by_hash, rank_in_group

FALLBACK_BAND = -1
MAX_BANDS = 1000


@dataclass(frozen=True)
class TripletSpace:
    """Numbered valid entities and their numbered items.

    ``entities``: entity, n, entity_rank. ``items``: entity, item, item_rank.
    """

    entities: DataFrame
    items: DataFrame
    entity_count: int
    item_count: int


def triplet_space(df: DataFrame, item: str, entity: str, seed: int = 42) -> TripletSpace:
    """Number the entities with at least two items, and their items."""
    ids = df.select(F.col(entity).alias("entity"), F.col(item).alias("item"))
    valid = written(valid_entities(ids, "entity"), "entities")
    total = valid.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no entity has two items, so no triplet can be formed")
    entities, count = dense_rank_by_hash(valid, "entity", seed, "entity_rank")
    items = rank_in_group(ids.join(valid.select("entity"), "entity", "left_semi"),
                          "entity", "item", seed, "item_rank")
    return TripletSpace(written(entities, "ranked-entities"), written(items, "ranked-items"),
                        count, int(total))


def sample_pairs(space: TripletSpace, n: int | None = None, seed: int = 42) -> DataFrame:
    """``n`` draws (default: one epoch) of ``t, entity, entity_rank, anchor, positive``.

    Entities are drawn uniformly with replacement, then two different items of each.
    """
    n = space.item_count if n is None else n
    spark = space.entities.sparkSession
    t = F.col("t")
    draws = spark.range(n).select(
        F.col("id").alias("t"),
        F.pmod(draw(seed, "entity", "id"), F.lit(space.entity_count)).alias("entity_rank"))
    drawn = draws.join(space.entities, "entity_rank")
    drawn = drawn.withColumn("_i", F.pmod(draw(seed, "anchor", t), F.col("n")))
    step = 1 + F.pmod(draw(seed, "positive", t), F.col("n") - 1)
    drawn = drawn.withColumn("_j", F.pmod(F.col("_i") + step, F.col("n")))
    first = space.items.select("entity", F.col("item_rank").alias("_i"), F.col("item").alias("anchor"))
    second = space.items.select("entity", F.col("item_rank").alias("_j"),
                                F.col("item").alias("positive"))
    return (drawn.join(first, ["entity", "_i"]).join(second, ["entity", "_j"])
            .select("t", "entity", "entity_rank", "anchor", "positive"))


def bandit_values(state: DataFrame | None) -> dict[int, tuple[int, float]]:
    """Band -> (count, reward sum). A state has one row per band, so it is tiny."""
    if state is None:
        return {}
    rows = state.select("band", "n", "reward_sum").limit(MAX_BANDS + 1).collect()
    if len(rows) > MAX_BANDS:
        raise ValueError("the bandit state must hold one row per band")
    return {r["band"]: (r["n"], r["reward_sum"]) for r in rows}


def select_band(bands: Column, state: dict[int, tuple[int, float]], key: Column,
                exploration: float = 2.0, warmup: int = 1000, seed: int = 42) -> Column:
    """Chosen band of an array of available bands given in order of first appearance.

    Before ``warmup`` updates: uniform. Afterwards the highest upper confidence bound, a
    band without updates first of all, ties to the band that appears first.
    """
    total = sum(n for n, _ in state.values())
    if total < warmup:
        return F.when(F.size(bands) > 0, F.get(
            bands, F.pmod(draw(seed, "band", key), F.greatest(F.size(bands), F.lit(1)))
            .cast("int")))
    known = {b: s / n + exploration * math.sqrt(math.log(total) / n) if n else math.inf
             for b, (n, s) in state.items()}

    table = F.create_map(*[F.lit(x) for b, v in known.items() for x in (b, float(v))]) \
        .cast("map<bigint,double>")

    def bound(b: Column) -> Column:
        return F.coalesce(F.try_element_at(table, b.cast("bigint")), F.lit(math.inf))

    ranked = F.transform(bands, lambda b, i: F.struct(
        bound(b).alias("u"), (-i).alias("first"), b.alias("band")))
    return F.array_max(ranked)["band"]


def sample_negatives(pairs: DataFrame, difficulty: DataFrame, space: TripletSpace,
                     state: DataFrame | None = None, exploration: float = 2.0,
                     warmup: int = 1000, seed: int = 42) -> DataFrame:
    """Add ``negative, negative_entity, band`` to pairs.

    The band is chosen among those of the anchor's neighbours; a valid neighbouring entity
    of that band is drawn with multiplicity, then one of its items. Without a neighbour row
    or a valid candidate: any other entity, band -1.
    """
    require_columns(difficulty, ["target_coord_hash", "neighbor_building_ids", "neighbor_bands"],
                    "difficulty table")
    t = F.col("t")
    near = difficulty.select(F.col("target_coord_hash").alias("anchor"),
                             "neighbor_building_ids", "neighbor_bands")
    base = pairs.join(near, "anchor", "left")
    bands = F.array_distinct(F.coalesce("neighbor_bands", F.array().cast("array<int>")))
    base = base.withColumn("_band", select_band(
        bands, bandit_values(state), t, exploration, warmup, seed))
    numbered = F.transform(
        F.arrays_zip(F.col("neighbor_building_ids").alias("e"), F.col("neighbor_bands").alias("b")),
        lambda x, i: F.struct(i.alias("pos"), x["e"].alias("e"), x["b"].alias("b")))
    base = base.withColumn("_c", F.filter(numbered, lambda x: x["b"] == F.col("_band")))
    keys = ["t", "entity", "entity_rank", "anchor", "positive", "_band"]
    options = base.select(*keys, F.explode_outer("_c").alias("_c")).select(
        *keys, F.col("_c.pos").alias("_pos"), F.col("_c.e").alias("_e"))
    known = space.entities.select(F.col("entity").alias("_e"), F.col("n").alias("_n"))
    # The least hash among the valid candidates is a uniform draw with multiplicity.
    option = F.when(F.col("_n").isNotNull(), F.struct(
        keyed_hash(f"{seed}|candidate", t, F.col("_pos")).alias("h"),
        F.col("_e").alias("e"), F.col("_n").alias("n")))
    picked = options.join(known, "_e", "left").groupBy(*keys).agg(F.min(option).alias("_pick"))
    m = space.entity_count
    other = F.pmod(F.col("entity_rank") + 1 + F.pmod(draw(seed, "other", t), F.lit(max(m - 1, 1))),
                   F.lit(m)) if m > 1 else F.col("entity_rank")
    picked = picked.withColumn("_other", F.when(F.col("_pick").isNull(), other))
    spare = space.entities.select(F.col("entity_rank").alias("_other"),
                                  F.col("entity").alias("_oe"), F.col("n").alias("_on"))
    picked = picked.join(spare, "_other", "left").select(
        "t", "entity", "anchor", "positive",
        F.coalesce("_pick.e", "_oe").alias("negative_entity"),
        F.coalesce("_pick.n", "_on").alias("_m"),
        F.when(F.col("_pick").isNotNull(), F.col("_band")).otherwise(FALLBACK_BAND).alias("band"))
    picked = picked.withColumn("_k", F.pmod(draw(seed, "negative", t), F.col("_m")))
    items = space.items.select(F.col("entity").alias("negative_entity"),
                               F.col("item_rank").alias("_k"), F.col("item").alias("negative"))
    return picked.join(items, ["negative_entity", "_k"]).select(
        "t", "entity", "anchor", "positive", "negative", "negative_entity", "band")


def attach_vectors(triplets: DataFrame, vectors: DataFrame, item: str, vector: str) -> DataFrame:
    """Add ``anchor_vec, positive_vec, negative_vec``.

    Each triplet becomes three (role, item) rows and is put together again, so the vector
    table is shuffled once and the triplets are computed once.
    """
    roles = ("anchor", "positive", "negative")
    needs = triplets.select("*", F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).alias("item")) for r in roles])).alias("_x")
    ).select(*triplets.columns, F.col("_x.role").alias("_role"), F.col("_x.item").alias("_item"))
    source = vectors.select(F.col(item).alias("_item"), F.col(vector).alias("_vec"))
    return needs.join(source, "_item").groupBy(*triplets.columns).agg(*[
        F.first(F.when(F.col("_role") == r, F.col("_vec")), ignorenulls=True).alias(f"{r}_vec")
        for r in roles])


def triplet_loss(anchor: Column, positive: Column, negative: Column, margin: float = 0.5,
                 distance: str = "euclidean") -> Column:
    """Loss of one triplet; its reward is the negative of it."""
    if distance == "euclidean":
        gap = euclidean(anchor, positive, 1e-6) - euclidean(anchor, negative, 1e-6)
    elif distance == "cosine":
        gap = cosine_distance(anchor, positive) - cosine_distance(anchor, negative)
    else:
        raise ValueError(f"unknown distance: {distance}")
    return F.greatest(gap + F.lit(margin), F.lit(0.0))


def scored_triplets(triplets: DataFrame, vectors: DataFrame, item: str, vector: str,
                    margin: float = 0.5, distance: str = "euclidean") -> DataFrame:
    """Triplets with ``loss`` and ``reward``."""
    full = attach_vectors(triplets, vectors, item, vector)
    loss = triplet_loss(F.col("anchor_vec"), F.col("positive_vec"), F.col("negative_vec"),
                        margin, distance)
    return (full.withColumn("loss", loss).withColumn("reward", -F.col("loss"))
            .drop("anchor_vec", "positive_vec", "negative_vec"))


def mean_loss(scored: DataFrame) -> DataFrame:
    """Mean over all triplets, infinite when there is none."""
    return scored.agg(F.coalesce(F.avg("loss"), F.lit(math.inf)).alias("val_loss"),
                      F.count(F.lit(1)).alias("triplets"))


def validation_loss(space: TripletSpace, difficulty: DataFrame, vectors: DataFrame, item: str,
                    vector: str, samples: int = 1000, margin: float = 0.5,
                    distance: str = "euclidean", warmup: int = 1000, seed: int = 42) -> DataFrame:
    """Mean loss of at most ``samples`` draws; validation gives no rewards, so no state.

    The draws go to the neighbour lists and vectors they need, so neither table is shuffled whole.
    """
    pairs = written(sample_pairs(space, min(samples, space.item_count), seed), "validation-pairs")
    anchors = pairs.select(F.col("anchor").alias("target_coord_hash")).distinct()
    difficulty = difficulty.join(sent_if_small(anchors), "target_coord_hash", "left_semi")
    drawn = written(sample_negatives(pairs, difficulty, space, None, warmup=warmup, seed=seed), "validation-draws")
    needed = drawn.select(F.explode(F.array("anchor", "positive", "negative")).alias(item)).distinct()
    vectors = vectors.join(sent_if_small(needed), item, "left_semi")
    return mean_loss(scored_triplets(drawn, vectors, item, vector, margin, distance))


def update_bandit(state: DataFrame | None, rewards: DataFrame) -> DataFrame:
    """Add rewards (``band``, ``reward``) to a state; fallback bands (< 0) do not count."""
    new = rewards.filter(F.col("band") >= 0).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward_sum"))
    if state is not None:
        new = state.select("band", "n", "reward_sum").unionByName(new)
        new = new.groupBy("band").agg(F.sum("n").alias("n"), F.sum("reward_sum").alias("reward_sum"))
    return new.withColumn("mean_reward", F.col("reward_sum") / F.col("n"))
