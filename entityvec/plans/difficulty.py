"""Difficulty table: features, neighbours, local scale, calibrated bands."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from entityvec.functions.scratch import written
from entityvec.operators.blocks import Layout
from entityvec.operators.neighbors import (
    assign_bands, calibrate_bands, check_neighbor_options, difficulty_rows, feature_table,
    knn_exclude_group, local_scale, neighbor_lists)


@dataclass(frozen=True)
class Difficulty:
    """``rows``: anchor with ``neigh``, ``local_scale`` and ``bands``; ``edges`` of the bands."""

    rows: DataFrame
    table: DataFrame
    edges: list[float]
    parameters: dict[str, object]


def difficulty_table(df: DataFrame, item: str, entity: str, vector: str | Column, k: int = 150,
                     k0: int = 50, sample_fraction: float = 0.03, seed: int = 42,
                     overfetch: int | None = None, layout: Layout | None = None,
                     parameters: dict[str, object] | None = None) -> Difficulty:
    """From vectors to the stored table. The neighbour lists are written once, because the
    calibration and the result both read them."""
    check_neighbor_options(k, k0)
    edges = knn_exclude_group(df, item, entity, vector, k, overfetch, layout)
    scaled = local_scale(written(neighbor_lists(edges, item, entity), "neighbours"), k0)
    cuts = calibrate_bands(scaled, item, sample_fraction, seed)
    rows = assign_bands(scaled, cuts)
    facts = {"neighbors": k, "k0_for_local_scale": k0,
             "sample_fraction_for_bands": sample_fraction, "band_edges": cuts,
             "distance_metric": "euclidean_visual", **(parameters or {})}
    return Difficulty(rows, difficulty_rows(rows, item, facts), cuts, facts)


def fingerprint_difficulty(fingerprints: DataFrame, components: int = 32,
                           **options) -> Difficulty:
    """The same from a fingerprint table, through PCA."""
    features, explained = feature_table(fingerprints, components)
    facts = {"pca_components": components, "explained_variance": explained}
    return difficulty_table(features, "streetview_image_id", "building_id", "features",
                            parameters=facts, **options)


def write_difficulty(difficulty: Difficulty, path: str) -> None:
    """Table (run parameters in the key column's metadata) for the triplet sampler."""
    difficulty.table.write.parquet(path)
