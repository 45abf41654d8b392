"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registry
from entityvec.operators import splits
from oracle import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_matches_sql(spark, name):
    rows, difference = compare(spark, SF_DIR, registry.queries()[name], registry.oracle_sql()[name])
    assert difference is None
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert registry.entry(spark).count() == 4


def test_pca_reduction_of_whole_vectors(spark):
    ids, x = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet' ORDER BY vec_id").fetchall())
    x = np.array(x, np.float64)
    assert x.shape[1] == 64
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    # Components are determined where the spectrum has gaps.
    assert (s[:32] - s[1:33]).min() > 1e-4
    got = registry.queries()["pca_reduction"](spark, SF_DIR).toPandas().pivot(index="vec_id", columns="c", values="size")
    assert got.index.tolist() == list(ids) and got.shape[1] == 32
    assert got.to_numpy() == pytest.approx(np.abs(centred @ vt[:32].T), abs=1e-5)


def test_recall_of_hashed_neighbours(spark):
    edges = {name: {(r.item, r.neighbor_item) for r in registry.queries()[name](spark, SF_DIR).collect()} for name in ("knn_lsh", "knn_kmeans")}
    assert len(edges["knn_kmeans"]) == 10_000
    assert len(edges["knn_lsh"] & edges["knn_kmeans"]) >= 0.9 * len(edges["knn_kmeans"])


@pytest.mark.parametrize("name", ["stream_inference", "stream_bandit"])
def test_streams_over_tables_of_several_files(spark, tmp_path, name):
    for t in ("pages", "events"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = sorted(map(tuple, registry.queries()[name](spark, SF_DIR).collect()))
    got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in rows] and len(rows) > 0
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in rows])


@pytest.mark.parametrize("name", ["band_edges", "assign_bands"])
def test_bands_are_those_of_all_rows(spark, monkeypatch, name):
    # As on tables of more rows than the least number that calibrates.
    monkeypatch.setattr(splits, "calibration_size", lambda n, fraction, least: min(n, max(math.ceil(n * fraction), 20)))
    rows, difference = compare(spark, SF_DIR, registry.queries()[name], registry.oracle_sql()[name])
    assert difference is None and rows > 0
