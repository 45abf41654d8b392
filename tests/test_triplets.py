import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityvec.operators import triplets
from entityvec.operators.inference import Projector
from entityvec.plans.epoch import harvest_epoch, stored_for_epochs

SIZES = {f"e{i}": 2 + i % 5 for i in range(20)} | {"big": 100, "lone": 1}
ITEMS = [(f"{e}-{j}", e) for e, n in SIZES.items() for j in range(n)]
TABLE = "target_coord_hash string, neighbor_building_ids array<string>, neighbor_bands array<int>"


@pytest.fixture(scope="module")
def space(spark):
    return triplets.triplet_space(spark.createDataFrame(ITEMS, "item string, entity string"), "item", "entity")


def difficulty(spark, rows):
    return spark.createDataFrame(rows, TABLE)


def test_space(space, spark):
    assert space.entity_count == 21 and space.item_count == len(ITEMS) - 1
    assert "lone" not in {r.entity for r in space.items.collect()}
    with pytest.raises(ValueError):
        triplets.triplet_space(spark.createDataFrame([("a", "x"), ("b", "y")], "i string, e string"), "i", "e")


def test_pairs(space, spark):
    rows = triplets.sample_pairs(space, 4200, seed=1).collect()
    assert len(rows) == 4200 and len({r.t for r in rows}) == 4200
    by_item = dict(ITEMS)
    assert all(r.anchor != r.positive and by_item[r.anchor] == by_item[r.positive] == r.entity for r in rows)
    # Entities are equally likely, whatever their size.
    counts = Counter(r.entity for r in rows)
    assert len(counts) == 21 and 140 < min(counts.values()) and max(counts.values()) < 260
    assert sorted(rows) == sorted(triplets.sample_pairs(space, 4200, seed=1).repartition(3).collect())
    assert triplets.sample_pairs(space).count() == space.item_count
    two = [r for r in rows if r.entity == "e0"]
    assert {(r.anchor, r.positive) for r in two} == {("e0-0", "e0-1"), ("e0-1", "e0-0")}


def test_negatives(space, spark):
    table = difficulty(spark, [
        (i, ["e1", "e2", "e2", "lone", "gone", "e3"], [0, 0, 0, 1, 1, 2]) for i, e in ITEMS if e == "big"
    ] + [("e5-0", [], [])])
    pairs = triplets.sample_pairs(space, 12_000, seed=2)
    rows = triplets.sample_negatives(pairs, table, space, seed=2).collect()
    assert len(rows) == 12_000
    by_item = dict(ITEMS)
    assert all(by_item[r.negative] == r.negative_entity != r.entity for r in rows)
    assert all(r.band == -1 for r in rows if r.entity != "big")
    big = [r for r in rows if r.entity == "big"]
    # Band 1 holds no valid entity, so those draws fall back to any other entity.
    bands = Counter(r.band for r in big)
    assert set(bands) == {0, 2, -1} and all(abs(c / len(big) - 1 / 3) < 0.1 for c in bands.values())
    assert {r.negative_entity for r in big if r.band == 2} == {"e3"}
    near = Counter(r.negative_entity for r in big if r.band == 0)
    assert set(near) == {"e1", "e2"} and 1.4 < near["e2"] / near["e1"] < 2.8
    assert len({r.negative_entity for r in big if r.band == -1}) > 15


def test_lone_entity_returns_itself(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "item string, entity string")
    space = triplets.triplet_space(df, "item", "entity")
    rows = triplets.sample_negatives(triplets.sample_pairs(space, 10), difficulty(spark, []), space).collect()
    assert {(r.negative_entity, r.band) for r in rows} == {("x", -1)}


def chosen(spark, bands, state, **options):
    df = spark.createDataFrame([(i, bands) for i in range(600)], "t int, b array<int>")
    return Counter(r[0] for r in df.select(triplets.select_band(F.col("b"), state, F.col("t"), **options)).collect())


def test_band_choice(spark):
    state = {0: (50, 10.0), 1: (30, 9.0), 2: (20, 4.0)}
    warm = chosen(spark, [2, 0], state, warmup=101)
    assert set(warm) == {0, 2} and min(warm.values()) > 200
    values = {b: s / n + 2.0 * math.sqrt(math.log(100) / n) for b, (n, s) in state.items()}
    assert chosen(spark, [0, 1, 2], state, warmup=100) == {max(values, key=values.get): 600}
    assert chosen(spark, [0, 1], state, warmup=0) == {max((0, 1), key=values.get): 600}
    # Unseen bands come first, the one that appears first among several.
    assert chosen(spark, [1, 6, 4], state, warmup=0) == {6: 600}
    same = {0: (5, 1.0), 1: (5, 1.0)}
    assert chosen(spark, [1, 0], same, warmup=0) == {1: 600}
    assert chosen(spark, [], state, warmup=0) == {None: 600}
    assert chosen(spark, [3, 0], {}, warmup=0) == {3: 600}
    assert chosen(spark, [], state) == {None: 600}


def test_bandit_state(spark):
    first = triplets.update_bandit(None, spark.createDataFrame(
        [(0, 1.0), (0, 2.0), (3, -1.0), (-1, 50.0)], "band int, reward double"))
    second = triplets.update_bandit(first, spark.createDataFrame([(3, -3.0), (5, 1.0)], "band int, reward double"))
    assert {r.band: (r.n, r.reward_sum, r.mean_reward) for r in second.collect()} == {
        0: (2, 3.0, 1.5), 3: (2, -4.0, -2.0), 5: (1, 1.0, 1.0)}
    assert triplets.bandit_values(second) == {0: (2, 3.0), 3: (2, -4.0), 5: (1, 1.0)}


def test_loss(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(list(map(float, v)) for v in rng.normal(size=(3, 4))) for _ in range(30)]
    df = spark.createDataFrame(rows, "a array<double>, p array<double>, n array<double>")
    for distance in ("euclidean", "cosine"):
        got = [r[0] for r in df.select(triplets.triplet_loss(
            F.col("a"), F.col("p"), F.col("n"), 0.5, distance)).collect()]
        want = []
        for a, p, n in (map(np.array, r) for r in rows):
            if distance == "euclidean":
                gap = np.linalg.norm(a - p + 1e-6) - np.linalg.norm(a - n + 1e-6)
            else:
                def cos(x, y):
                    return x @ y / np.linalg.norm(x) / np.linalg.norm(y)
                gap = cos(a, n) - cos(a, p)
            want.append(max(0.0, gap + 0.5))
        assert got == pytest.approx(want) and 0.0 in got and max(got) > 0
    with pytest.raises(ValueError):
        triplets.triplet_loss(F.col("a"), F.col("p"), F.col("n"), 0.5, "x")
    assert triplets.mean_loss(df.select(F.lit(1.0).alias("loss")).limit(0)).first().val_loss == math.inf


def test_epochs(space, spark):
    rng = np.random.default_rng(0)
    vecs = spark.createDataFrame([(i, list(map(float, rng.normal(size=6)))) for i, _ in ITEMS],
                                 "item string, vec array<double>")
    table = difficulty(spark, [(i, ["e1", "e2", "e3"], [0, 1, 2]) for i, e in ITEMS if e not in ("e1", "e2", "e3")])
    weights = Projector((rng.normal(size=(8, 6)), np.zeros(8)), (rng.normal(size=(4, 8)), np.zeros(4)))
    one = harvest_epoch(space, table, vecs, "item", "vec", weights=weights, n=300, warmup=100)
    counted = sum(n for n, _ in triplets.bandit_values(one.state).values())
    assert counted == one.triplets.filter("band >= 0").count() > 100
    assert one.loss.first().triplets == 300
    for b, (n, s) in triplets.bandit_values(one.state).items():
        r = one.triplets.filter(F.col("band") == b).agg(F.count("*"), F.sum("reward")).first()
        assert (r[0], pytest.approx(r[1])) == (n, s)
    # The state is above the warm-up now: all draws of the next epoch take the best band.
    two = harvest_epoch(space, table, vecs, "item", "vec", one.state, 200, weights, warmup=100, seed=7)
    assert two.triplets.filter("band >= 0").select("band").distinct().count() == 1
    loss = triplets.validation_loss(space, table, vecs, "item", "vec", samples=50)
    assert loss.first().triplets == 50


def above_scans(plan: str, table: str) -> list[str]:
    """Operators between the scan of ``table`` and the join that reads it, in the text of a physical plan."""
    lines, out = plan.splitlines(), []
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for at, line in enumerate(lines):
        if "Scan" in line and table in line:
            own = depth[at]
            for above in range(at - 1, -1, -1):
                if depth[above] < own:
                    own = depth[above]
                    if "Join" in lines[above]:
                        break
                    out.append(lines[above].strip(" :+-*"))
    return out


def test_stored_tables_are_not_shuffled_by_an_epoch(space, spark, tmp_path):
    rng = np.random.default_rng(0)
    vecs = spark.createDataFrame([(i, list(map(float, rng.normal(size=6)))) for i, _ in ITEMS], "item string, vec array<double>")
    table = difficulty(spark, [(i, ["e1", "e2", "e3"], [0, 1, 2]) for i, e in ITEMS if e not in ("e1", "e2", "e3")])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, near = stored_for_epochs(table, vecs, "item", str(tmp_path), "stored")
        drawn = triplets.sample_negatives(triplets.sample_pairs(space, 100, 3), rows, space, seed=3)
        scored = triplets.scored_triplets(drawn, near, "item", "vec")
        plan = scored._jdf.queryExecution().executedPlan().toString()
        for name in ("stored_difficulty", "stored_vectors"):
            between = above_scans(plan, name)
            assert between and not any("Exchange" in x for x in between), between
        assert "Exchange" in "".join(above_scans(triplets.scored_triplets(
            triplets.sample_negatives(triplets.sample_pairs(space, 100, 3), spark.read.parquet(str(tmp_path / "difficulty")), space, seed=3),
            spark.read.parquet(str(tmp_path / "vectors")), "item", "vec")._jdf.queryExecution().executedPlan().toString(), "FileScan parquet [target_coord_hash"))
        plain = triplets.scored_triplets(triplets.sample_negatives(triplets.sample_pairs(space, 100, 3), table, space, seed=3), vecs, "item", "vec")
        assert sorted(map(str, scored.collect())) == sorted(map(str, plain.select(scored.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE IF EXISTS stored_difficulty")
        spark.sql("DROP TABLE IF EXISTS stored_vectors")
