"""Nearest neighbours outside the own entity, local scale and difficulty bands."""

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityvec.functions.schema import require_columns
from entityvec.functions.vectors import scale_pixels
from entityvec.operators.blocks import BlockSearch, Layout, candidate_rows
from entityvec.operators.ranking import exact_percentiles
from entityvec.operators.splits import calibration_sample

# Percentiles between the difficulty bands, and columns of the stored table.
BAND_PERCENTILES = (5, 10, 20, 40, 60, 85)
DIFFICULTY_COLUMNS = ("target_coord_hash", "neighbor_building_ids",
                      "neighbor_distances_meters", "neighbor_bands")
# Fixed value: extra neighbours fetched before same-entity ones are removed.
OVERFETCH = 50


def check_neighbor_options(k: int, k0: int) -> None:
    if k0 >= k:
        raise ValueError("k0 must be less than the number of neighbours")


def pca_reduce(df: DataFrame, vector: str, k: int = 32,
               output: str = "features") -> tuple[DataFrame, float]:
    """Centred principal components and the share of variance they explain.

    The covariance is summed on the executors; only dims x dims numbers reach the driver.
    The sign of a component is arbitrary.
    """
    vec = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec.select("_v"))
    mean = vec.select(_mean_vector("_v")).first()[0]
    shift = model.pc.toArray().T @ mean.toArray()
    projected = model.transform(vec).withColumn("_p", vector_to_array("_p"))
    centre = F.array(*[F.lit(float(x)) for x in shift])
    out = projected.withColumn(output, F.zip_with("_p", centre, lambda x, m: x - m))
    return out.drop("_v", "_p"), float(sum(model.explainedVariance))


def _mean_vector(column: str) -> Column:
    return Summarizer.mean(F.col(column))


def feature_table(df: DataFrame, components: int = 32,
                  fingerprint: str = "fingerprint") -> tuple[DataFrame, float]:
    """Ids as strings and PCA features of pixel values scaled to 0..1."""
    require_columns(df, ["streetview_image_id", "building_id", fingerprint], "fingerprints")
    scaled = df.select(F.col("streetview_image_id").cast("string").alias("streetview_image_id"),
                       F.col("building_id").cast("string").alias("building_id"),
                       scale_pixels(F.col(fingerprint)).alias("_pixels"))
    reduced, explained = pca_reduce(scaled, "_pixels", components)
    return reduced.select("streetview_image_id", "building_id", "features"), explained


def knn_exclude_group(df: DataFrame, item: str, entity: str, vector: str | Column,
                      k: int = 150, overfetch: int | None = None,
                      layout: Layout | None = None) -> DataFrame:
    """Edges ``item, entity, neighbor_item, neighbor_entity, distance, rank``.

    Euclidean, the k nearest items of other entities, ties by item id. Items without an entity
    form one, so an item is never its own neighbour. With ``overfetch``
    the k + overfetch nearest of all items (itself included) are fetched first and those of
    the same entity removed afterwards, so fewer than k may remain. An item without any
    neighbour keeps one edge with null neighbour.
    """
    search = BlockSearch(candidate_rows(df, item, entity, vector), "euclidean", layout)
    if overfetch is None:
        edges = search.nearest(k, exclude_group=True)
    else:
        edges = search.nearest(min(search.size, k + overfetch))
        foreign = F.col("nb_id").isNull() | ~F.col("nb_grp").eqNullSafe(F.col("grp"))
        # The kept ranks are the place among the foreign neighbours; the row itself stays
        # in as a marker so that no anchor disappears.
        edges = _rerank(edges.withColumn("_f", foreign), k)
    return edges.select(F.col("id").alias(item), F.col("grp").alias(entity),
                        F.col("nb_id").alias("neighbor_item"),
                        F.col("nb_grp").alias("neighbor_entity"),
                        F.col("score").alias("distance"), "rank")


def _rerank(edges: DataFrame, k: int) -> DataFrame:
    by_row = Window.partitionBy("id").orderBy(F.col("_f").desc(), "rank")
    out = edges.withColumn("_new", F.row_number().over(by_row)).filter(F.col("_new") <= k)
    blank = ~F.col("_f")
    for c in ("nb_id", "nb_grp", "score"):
        out = out.withColumn(c, F.when(blank, F.lit(None)).otherwise(F.col(c)))
    return (out.filter(F.col("_f") | (F.col("_new") == 1))
            .withColumn("rank", F.col("_new")).drop("_new", "_f"))


def nearest_items(queries: DataFrame, corpus: DataFrame, item: str, vector: str, k: int = 10,
                  metric: str = "dot", layout: Layout | None = None) -> DataFrame:
    """The k nearest corpus items of each query; ``dot`` equals cosine on unit vectors."""
    none = F.lit(None).cast("string")
    search = BlockSearch(corpus.select(F.col(item).alias("id"), none.alias("grp"),
                                       F.col(vector).alias("vec")), metric, layout)
    asked = queries.select(F.col(item).alias("id"), none.alias("grp"), F.col(vector).alias("vec"))
    found = search.nearest(k, asked)
    score = -F.col("score") if metric == "dot" else F.col("score")
    return found.filter(F.col("nb_id").isNotNull()).select(
        F.col("id").alias(item), F.col("nb_id").alias("neighbor_item"),
        score.alias("score"), "rank")


def neighbor_lists(edges: DataFrame, item: str, entity: str) -> DataFrame:
    """One row per item: ``neigh`` = array of (dist, item, entity), nearest first."""
    entry = F.struct(F.col("rank"), F.col("distance").alias("dist"),
                     F.col("neighbor_item").alias("item"),
                     F.col("neighbor_entity").alias("entity"))
    found = F.collect_list(F.when(F.col("neighbor_item").isNotNull(), entry))
    # At most k entries per item: the edges are already cut at k.
    return edges.groupBy(item).agg(F.first(entity).alias(entity),
                                   F.array_sort(found).alias("neigh"))


def local_scale(lists: DataFrame, k0: int = 50) -> DataFrame:
    """Add ``local_scale`` (single precision) and ``short`` (fewer than k0 neighbours)."""
    d = F.transform("neigh", lambda e: e["dist"])
    n = F.size("neigh")
    at = F.when(n > 0, F.element_at(d, F.least(F.lit(k0), F.greatest(n, F.lit(1))))).otherwise(1.0)
    positive = F.get(F.filter(d, lambda x: x > 0), F.lit(0))
    scale = F.when(at > 0, at).otherwise(F.coalesce(positive, F.lit(1.0)))
    return (lists.withColumn("local_scale", scale.cast("float"))
            .withColumn("short", n < k0))


def ratios(scaled: DataFrame) -> Column:
    """Distance over local scale for each neighbour."""
    return F.transform(F.arrays_zip(F.transform("neigh", lambda e: e["dist"]).alias("d"),
                                    F.array_repeat("local_scale", F.size("neigh")).alias("s")),
                       lambda p: p["d"] / p["s"].cast("double"))


def calibrate_bands(scaled: DataFrame, item: str, fraction: float = 0.03, seed: int = 42,
                    percents: Sequence[float] = BAND_PERCENTILES,
                    minimum: int = 10_000) -> list[float]:
    """Band edges: percentiles of the ratios of a sample of anchors, in single precision."""
    sample = calibration_sample(scaled, item, fraction, seed, minimum)
    values = sample.select(F.explode(ratios(sample)).alias("r")).select(
        F.col("r").cast("float").alias("ratio"))
    return [float(np.float32(e)) for e in exact_percentiles(values, "ratio", percents)]


def assign_bands(scaled: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Add ``bands``: per neighbour the number of edges that its ratio reaches."""
    known = [float(e) for e in edges]

    def band(r: Column) -> Column:
        out = F.lit(0)
        for e in known:
            out = out + F.when(r >= F.lit(e), 1).otherwise(0)
        return out

    return scaled.withColumn("bands", F.transform(ratios(scaled), band))


def difficulty_rows(banded: DataFrame, item: str,
                    parameters: dict[str, object] | None = None) -> DataFrame:
    """Stored form: parallel lists per anchor, nearest first, of *entity* ids.

    The column names are the established ones of that table. Run parameters travel as
    metadata of the key column and survive Parquet.
    """
    facts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (parameters or {}).items()}
    return banded.select(
        F.col(item).alias("target_coord_hash", metadata=facts),
        F.transform("neigh", lambda e: e["entity"]).alias("neighbor_building_ids"),
        F.transform("neigh", lambda e: e["dist"]).alias("neighbor_distances_meters"),
        F.col("bands").alias("neighbor_bands"))
