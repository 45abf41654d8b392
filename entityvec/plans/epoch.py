"""Data side of one training epoch: draw, project, score, update the bandit."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityvec.functions.scratch import written
from entityvec.operators.inference import Projector, project_vectors
from entityvec.operators.triplets import (
    TripletSpace, sample_negatives, sample_pairs, scored_triplets, update_bandit)
from entityvec.sources.tables import write_bucketed


@dataclass(frozen=True)
class Epoch:
    triplets: DataFrame
    state: DataFrame
    loss: DataFrame


def harvest_epoch(space: TripletSpace, difficulty: DataFrame, vectors: DataFrame, item: str,
                  vector: str, state: DataFrame | None = None, n: int | None = None,
                  weights: Projector | None = None, margin: float = 0.5,
                  distance: str = "euclidean", exploration: float = 2.0, warmup: int = 1000,
                  seed: int = 42) -> Epoch:
    """Draws of one epoch with a frozen bandit state; rewards count from the next epoch on.

    Difficulty rows are joined on their anchor and vectors on their item. Stored once by :func:`stored_for_epochs`,
    neither is shuffled again, however many epochs read them.
    """
    pairs = sample_pairs(space, n, seed)
    drawn = sample_negatives(pairs, difficulty, space, state, exploration, warmup, seed)
    if weights is not None:
        vectors = project_vectors(vectors.select(item, vector), weights, vector, "_projected") \
            .select(item, F.col("_projected").alias(vector))
    scored = written(scored_triplets(drawn, vectors, item, vector, margin, distance), "epoch")
    return Epoch(scored, update_bandit(state, scored), scored.agg(
        F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("triplets")))


def stored_for_epochs(difficulty: DataFrame, vectors: DataFrame, item: str, folder: str, name: str,
                      buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The difficulty rows and the item vectors as tables in buckets of their join keys, under ``folder``.

    The tables are ``name``_difficulty and ``name``_vectors in the session's catalog, for the caller to drop.
    """
    return (write_bucketed(difficulty, f"{name}_difficulty", "target_coord_hash", f"{folder}/difficulty", buckets),
            write_bucketed(vectors, f"{name}_vectors", item, f"{folder}/vectors", buckets))
