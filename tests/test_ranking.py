import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityvec.operators import entities, ranking, splits
from entityvec.plans.assembly import entity_split, unmatched_entities


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def test_cuts(spark):
    df = spark.range(1000)
    want = order(range(1000))
    total, cuts = ranking.hash_cuts(df, "id", 42, lambda n: [0, 1, 500, n - 1, n, n + 5])
    assert total == 1000
    for size, cut in zip((0, 1, 500, 999, 1000, 1000), cuts):
        assert sorted(r.id for r in df.filter(cut.covers(42, F.col("id"))).collect()) == sorted(want[:size])


def test_cuts_of_nothing(spark):
    total, cuts = ranking.hash_cuts(spark.range(0), "id", 1, lambda n: [n])
    assert total == 0 and cuts[0].digest is None


def test_dense_rank(spark):
    ranked, n = ranking.dense_rank_by_hash(spark.range(500), "id", 7)
    got = [r.id for r in ranked.orderBy("rank").collect()]
    assert n == 500 and got == order(range(500), 7)


@pytest.mark.parametrize("hot_rows", [5, 1000])
def test_rank_in_group(spark, hot_rows):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 120, "hot").otherwise((F.col("id") % 40).cast("string")))
    rows = ranking.rank_in_group(df, "g", "id", 3, hot_rows=hot_rows).collect()
    assert len(rows) == 300
    for g in {r.g for r in rows}:
        got = [r.id for r in sorted((r for r in rows if r.g == g), key=lambda r: r.rank)]
        assert got == order(got, 3)
        assert sorted(r.rank for r in rows if r.g == g) == list(range(len(got)))


@pytest.mark.parametrize("small", [0, 10**9])
def test_percentiles(spark, small):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=5000), np.repeat([1.0, 2.0, 7.5], [4000, 1, 900]), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = ranking.exact_percentiles(df, "x", [0, 5, 10, 20, 40, 60, 85, 100], buckets=16, small=small)
        assert got == pytest.approx(np.percentile(values, [0, 5, 10, 20, 40, 60, 85, 100]), rel=1e-12)
    with pytest.raises(ValueError):
        ranking.exact_percentiles(df.limit(0), "x", [5], small=small)


def items(spark, partitions=4):
    # Entity 0 holds a third of all rows; entities from 100 on are singletons.
    e = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") > 280, F.col("id") + 100).otherwise(F.col("id") % 50)
    return spark.range(0, 300, 1, partitions).select("id", e.alias("entity"))


def test_split(spark):
    rows = entity_split(items(spark), "entity", seed=5).collect()
    per_entity = {}
    for r in rows:
        per_entity.setdefault(r.entity, set()).add(r.split)
    assert all(len(s) == 1 for s in per_entity.values())
    n = len(per_entity)
    sizes = [sum(s == {x} for s in per_entity.values()) for x in ("train", "val", "test")]
    assert sizes == [int(n * 0.7), int(n * 0.15), n - int(n * 0.7) - int(n * 0.15)]
    assert rows and sorted(rows) == sorted(entity_split(items(spark, 9), "entity", seed=5).collect())
    other = {r.entity: r.split for r in entity_split(items(spark), "entity", seed=6).collect()}
    assert other != {k: next(iter(v)) for k, v in per_entity.items()}
    counts = {r.entity: r.n for r in entities.entity_counts(items(spark), "entity").collect()}
    assert set(per_entity) == {e for e, c in counts.items() if c > 1}
    assert len(rows) == sum(c for c in counts.values() if c > 1)


def test_leakage_and_maps(spark):
    df = spark.createDataFrame([(1, "train"), (1, "val"), (2, "test"), (2, "test")], "e int, split string")
    assert [(r.e, r.splits) for r in entities.split_leakage(df, "e").collect()] == [(1, 2)]
    assert entities.split_leakage(entity_split(items(spark), "entity"), "entity").count() == 0
    known = spark.createDataFrame([(1, "val")], "e int, split string")
    rows = spark.createDataFrame([(1,), (9,)], "e int")
    assert sorted(map(tuple, splits.attach_split(rows, known, "e").collect())) == [(1, "val"), (9, "test")]
    assert [r.e for r in unmatched_entities(rows, known, "e").collect()] == [9]


def test_helper_columns_go_and_ids_come(spark):
    df = spark.createDataFrame(
        [(1, 2, 3, "t", "p"), (1, 2, 4, "t", "p")],
        "dataset_id int, target_id int, patch_id int, tar_file string, image_path string")
    out = entity_split(df)
    assert out.columns == ["dataset_id", "target_id", "patch_id", "building_id",
                           "streetview_image_id", "split"]
    assert {r.building_id for r in out.collect()} == {"0001_2"}


@pytest.mark.parametrize("ratios", [(0.7, 0.2, 0.2), (1.2, -0.1, -0.1)])
def test_bad_ratios(spark, ratios):
    with pytest.raises(ValueError):
        splits.split_of(spark.range(3), "id", 1, *ratios)


def test_samples(spark):
    df = items(spark)
    assert splits.sample_entities(df, "entity", n=7, fraction=0.9).select("entity").distinct().count() == 7
    assert splits.sample_entities(df, "entity", n=10**6).count() == 300
    assert splits.sample_entities(df, "entity", fraction=0.001).select("entity").distinct().count() == 1
    assert splits.sample_entities(df, "entity", fraction=1.0) is df
    assert splits.sample_entities(df, "entity", n=0) is df
    head = splits.per_entity_head(df, "entity", "id", 1).collect()
    assert {r.entity: r.id for r in head}[0] == 0 and all(r.entity <= 100 for r in head)
    assert splits.per_entity_head(df, "entity", "id", 0).count() == entities.drop_singletons(df, "entity").count()
    assert splits.cap_queries(df, "id", 5).count() == 5
    assert splits.cap_queries(df, "id", 0).count() == 300
    assert splits.calibration_sample(df.select("id"), "id", 0.5, minimum=10).count() == 150
    assert splits.calibration_sample(df.select("id"), "id", 0.001, minimum=10).count() == 10
    assert splits.calibration_sample(df.select("id"), "id", 0.03).count() == 300


def test_reports(spark):
    df = items(spark)
    r = entities.singleton_report(df, "entity").first()
    assert r.rows_before == 300 and r.rows_before - r.rows_after == r.entities_before - r.entities_after
    assert entities.epoch_length(df, "entity") == r.rows_after
    with pytest.raises(ValueError):
        entities.epoch_length(spark.range(3), "id")
    pooled = entities.mean_pool(spark.createDataFrame(
        [(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [0.0, 0.0])], "e int, v array<double>"), "e", "v")
    got = {x.e: x.v for x in pooled.collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_summary_of_stored_ids(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 5, 6, "0001_5"), ("x", 5, 7, "zz"), (None, None, 7, None)],
        "dataset_id string, targetID int, patch_id int, building_id string")
    r = entities.distinct_id_summary(df).first()
    assert tuple(r) == (1, 1, 2, 2, 1)
    df.drop("dataset_id", "building_id").write.parquet(str(tmp_path / "s"))
    named = spark.createDataFrame([(1, 2, "a/0007.parquet"), (1, 3, "b.parquet")],
                                  "target_id int, patch_id int, f string")
    assert tuple(entities.distinct_id_summary(named, F.col("f")).first()) == (1, 1, 2, 1, 1)
    assert entities.distinct_id_summary(spark.read.parquet(str(tmp_path / "s"))).first().patch_id == 2
