import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.shipping import ship_arrays, unpack_arrays
from entityvec.operators import blocks, lsh, neighbors, retrieval
from entityvec.operators.balls import Balls
from entityvec.operators.lsh import knn_by_hashing
from entityvec.operators.blocks import BlockSearch, CellSummary, Layout, ShortScores, _bounds, _nearest, _route, _struct_of, best_pairs, few_places

LAYOUTS = [Layout(), Layout(block_rows=16, cells=9, tile=10),
           Layout(block_rows=1000, cells=40), Layout(block_rows=7, cells=1, tile=3),
           Layout(block_rows=16, cells=24, parts=3, tree=True), Layout(block_rows=16, cells=9, parts=20, refined=True),
           Layout(block_rows=16, cells=9, parts=8, refined=True, tree=True)]


def data(kind: str, n=240, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.random((n, d)) * 9)
    e = [f"e{i % 25}" for i in range(n)]
    if kind == "copies":  # a third of all rows is the same vector, over all entities
        x[::3] = 4.0
    elif kind == "hot":  # a third of all rows belongs to one entity, and those lie together
        for i in range(0, n, 3):
            e[i] = "hot"
            x[i] = np.floor(rng.random(d) * 2) + 20
    elif kind == "hot_copies":
        for i in range(0, n, 3):
            e[i], x[i] = "hot", 4.0
    elif kind == "no_entity":
        e[::4] = [None] * len(e[::4])
    elif kind == "clusters":
        x = x + 100 * (np.arange(n) % 5)[:, None]
    return [(f"i{i:04d}", e[i], [float(v) for v in x[i]]) for i in range(n)]


def brute(rows, k, exclude=True, queries=None, metric="euclidean"):
    x = np.array([r[2] for r in rows])
    out = {}
    for item, entity, vec in queries or rows:
        v = np.array(vec)
        s = -(x @ v) if metric == "dot" else np.sqrt(((x - v) ** 2).sum(1))
        found = sorted((s[j], rows[j][0]) for j in range(len(rows))
                       if not exclude or rows[j][1] != entity)
        out[item] = [(i, round(float(a), 9)) for a, i in found[:k]]
    return out


def frame(spark, rows, partitions=5):
    return spark.createDataFrame(rows, "item string, entity string, vec array<double>").repartition(partitions)


def found(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item"], [])
        if r["neighbor_item"] is not None:
            out[r["item"]].append((r["neighbor_item"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("kind", ["plain", "copies", "hot", "hot_copies", "clusters", "no_entity"])
@pytest.mark.parametrize("layout", LAYOUTS, ids=range(len(LAYOUTS)))
def test_knn_is_exact(spark, kind, layout):
    rows = data(kind)
    got = neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", k=12, layout=layout)
    assert found(got) == brute(rows, 12)


def test_more_neighbours_than_there_are(spark):
    rows = data("plain", 30)
    for layout in LAYOUTS[:2]:
        got = neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", k=100, layout=layout)
        assert found(got) == brute(rows, 100)


def test_no_neighbour_at_all(spark):
    rows = [(f"i{i}", "one", [float(i)]) for i in range(5)]
    got = neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", k=3)
    assert found(got) == {f"i{i}": [] for i in range(5)}
    lists = neighbors.local_scale(neighbors.neighbor_lists(got, "item", "entity"))
    assert {(r.local_scale, r.short) for r in lists.collect()} == {(1.0, True)}


def test_real_numbers_and_duplicates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16))
    x[75:] = x[:75]
    rows = [(f"i{i:04d}", f"e{i}", list(map(float, x[i]))) for i in range(150)]
    got = found(neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", k=5,
                                            layout=Layout(block_rows=20, cells=12)))
    want = brute(rows, 5)
    for item, near in got.items():
        assert near[0][1] == 0.0
        assert [i for i, _ in near] == [i for i, _ in want[item]]
        assert [d for _, d in near] == pytest.approx([d for _, d in want[item]], abs=1e-8)


@pytest.mark.parametrize("kind", ["plain", "hot"])
def test_overfetch_drops_after_the_cut(spark, kind):
    rows = data(kind)
    by_id = {r[0]: r[1] for r in rows}
    want = {i: [x for x in near if by_id[x[0]] != by_id[i]][:4]
            for i, near in brute(rows, 10, exclude=False).items()}
    got = neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", k=4, overfetch=6)
    assert found(got) == want


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
@pytest.mark.parametrize("layout", LAYOUTS[:3], ids=range(3))
def test_search_of_other_queries(spark, metric, layout):
    rows, asked = data("copies"), data("plain", 40, seed=9)
    got = neighbors.nearest_items(frame(spark, asked), frame(spark, rows), "item", "vec", 9, metric, layout)
    out = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        s = -r["score"] if metric == "dot" else r["score"]
        out.setdefault(r["item"], []).append((r["neighbor_item"], round(s, 9)))
    assert out == brute(rows, 9, False, asked, metric)


def test_pruning_leaves_far_cells_alone(spark):
    rows = frame(spark, data("clusters", 600))
    search = BlockSearch(rows.select(F.col("item").alias("id"), F.col("entity").alias("grp"), "vec"),
                         layout=Layout(block_rows=64, cells=30))
    member = _struct_of(search.corpus.schema, [T.StructField("bound", T.DoubleType())])
    met = search._meet(search._blocks, search._blocks, search._cells, 5, True, True, member)
    sent = met.filter("not home").agg(F.sum(F.size("pack"))).first()[0]
    # Five clusters far apart: a row meets about a fifth of the blocks at most.
    assert sent < 600 * search.summary.blocks.sum() * 0.3


def test_equal_vectors_give_no_more_than_k_edges():
    n, k = 2000, 150
    rows = pa.array([{"id": f"i{i:05d}", "grp": f"e{i}", "vec": [1.0, 2.0], "bound": 0.0} for i in range(n)])
    found = [np.concatenate(x) for x in zip(*best_pairs(rows, rows, "euclidean", k, True, 512))]
    assert len(found[0]) == n * k and (np.bincount(found[0]) == k).all()
    # Equal scores go to the smallest ids of other groups.
    first = sorted(found[1][found[0] == 3])
    assert first == [i for i in range(k + 1) if i != 3]


def test_a_row_travels_once_for_each_large_block(spark):
    n, k = 30_000, 150
    draw = np.random.default_rng(0)
    x = draw.normal(size=(n, 32)) / np.sqrt(np.arange(1, 33))
    rows = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(x)], "id int, grp int, vec array<double>")
    search = BlockSearch(rows)
    member = _struct_of(search.corpus.schema, [T.StructField("bound", T.DoubleType())])
    met = search._meet(search._blocks, search._blocks, search._cells, k, True, True, member)
    assert search.summary.blocks.sum() <= 4
    assert met.agg(F.sum(F.size("pack"))).first()[0] <= n * search.summary.blocks.sum()
    edges = met.select("home", "pack", "rows").mapInArrow(
        _nearest("euclidean", k, True, 1024), "id int, grp int, nb_id int, nb_grp int, score double")
    assert edges.filter("nb_id is not null").count() <= 2 * n * k


def test_edges_do_not_follow_the_number_of_blocks(spark):
    n, k = 6000, 20
    x = np.random.default_rng(0).normal(size=(n, 32))
    rows = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(x)], "id int, grp int, vec array<double>")
    search = BlockSearch(rows, layout=Layout(block_rows=16, cells=4))
    member = _struct_of(search.corpus.schema, [T.StructField("bound", T.DoubleType())])
    met = search._meet(search._blocks, search._blocks, search._cells, k, True, True, member)
    edges = met.select("home", "pack", "rows").mapInArrow(
        _nearest("euclidean", k, True, 1024), "id int, grp int, nb_id int, nb_grp int, score double")
    assert search.summary.blocks.sum() >= 16
    # Without rows from elsewhere, a bound leaves some k edges in each of the 16 blocks.
    assert edges.filter("nb_id is not null").count() <= 11 * n * k


def test_short_tiles_grow_with_the_corpus(spark, monkeypatch):
    n, k, used = 4000, 20, []
    monkeypatch.setattr(blocks, "_nearest", lambda metric, k, exclude, tile: used.append(tile) or _nearest(metric, k, exclude, tile))
    monkeypatch.setattr(blocks, "_route", lambda cells, k, exclude, self_join, tile, probe=None: (
        used.append(tile) or _route(cells, k, exclude, self_join, tile, probe)))
    x = np.random.default_rng(0).integers(0, 256, (n, 16)).astype(float)
    rows = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(x)], "item int, entity int, vec array<double>")
    edges = neighbors.knn_exclude_group(rows, "item", "entity", "vec", k, layout=Layout(block_rows=32, cells=24, tile=16))
    # Tiles of 16 rows would be n * n / 256, each with its own calls.
    assert len(used) == 2 and min(used) >= n / 16
    got = edges.filter("item in (0, 1999, 3999)").orderBy("item", "rank").collect()
    for i, q in enumerate((0, 1999, 3999)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [(r.distance, r.neighbor_item) for r in got[i * k:][:k]] == sorted((d[j], j) for j in range(n) if j // 4 != q // 4)[:k]


def test_bounds_of_a_large_block_in_little_memory():
    n, k = 24_000, 150
    x = np.random.default_rng(0).normal(size=(n, 16))
    groups = pa.array(np.arange(n) // 4)
    one = np.ones(1, np.int64)
    summary = CellSummary("euclidean", x[:1], np.array([0], dtype=object), one * n, one * 4, np.zeros(1), np.full(1, 9.0), one)
    tracemalloc.start()
    bound = _bounds(x[:1024], groups[:1024], summary, k, True, True, 1024)
    bound = np.minimum(bound, _bounds(x, groups, summary, k, True, True, 1024)[:1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.sqrt(((x[:200, None, :] - x[None]) ** 2).sum(2))
    d[np.arange(200)[:, None] // 4 == np.arange(n)[None, :] // 4] = np.inf
    kth = np.sort(d, axis=1)[:, k - 1]
    assert (bound[:200] >= kth).all() and (bound[:200] <= kth * 1.001).all()
    assert peak < 150 << 20


def test_what_is_shipped_is_held_once(spark):
    x = np.random.default_rng(0).normal(size=(65_536, 64))
    sent = ship_arrays(spark, {"probes": x, "none": np.zeros((0, 3)), "turned": x[:5].T, "part": x[:5, ::2], "names": pa.array(["a", None])})
    assert len(sent.value) and len(unpack_arrays(sent)) == 5
    tracemalloc.start()
    got = unpack_arrays(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got["probes"] == x).all() and got["none"].shape == (0, 3) and got["names"].to_pylist() == ["a", None]
    assert (got["turned"] == x[:5].T).all() and (got["part"] == x[:5, ::2]).all()
    assert peak < x.nbytes / 10


def test_blocks_are_counted_without_python_workers(spark):
    search = BlockSearch(spark.createDataFrame([(i, i % 5, [float(i), 1.0]) for i in range(50)], "id int, grp int, vec array<double>"))
    plan = search._blocks._jdf.queryExecution().executedPlan().toString()
    # A list of rows would be an RDD that Python workers read.
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert search._blocks.selectExpr("sum(size(rows)) AS n").first()["n"] == 50


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
def test_single_precision_of_many_rows_in_little_memory(metric):
    b = np.random.default_rng(0).normal(size=(65_536, 64))
    tracemalloc.start()
    short = ShortScores.of(b[:1024], b, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s, least, error = short.tile(slice(0, 20), slice(0, 500), np.zeros(20))
    want = -(b[:20] @ b[:500].T) if metric == "dot" else ((b[:20, None] - b[None, :500]) ** 2).sum(2)
    assert np.abs(s - least[:, None] - want).max() <= error
    # The short rows, and slices of the long ones.
    assert peak < short.b.nbytes + b.nbytes


@pytest.mark.parametrize("kind", ["near", "far", "copies", "tiny", "huge", "spread", "odd"])
@pytest.mark.parametrize("metric", ["euclidean", "dot"])
def test_single_precision_loses_nothing(kind, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 9))
    x = {"near": x, "far": x + 1e6, "copies": np.round(x) + 1e4, "tiny": x * 1e-20, "huge": x * 1e20,
         "spread": x * 10.0 ** rng.integers(-4, 5, (700, 1)), "odd": np.where(x > 2.5, np.inf, x)}[kind]
    ids = np.array([f"i{i:04d}" for i in rng.permutation(700)])
    rows = pa.array([{"id": i, "grp": f"g{j % 40}", "vec": v.tolist(), "bound": np.inf} for j, (i, v) in enumerate(zip(ids, x))])
    found = {}
    with np.errstate(all="ignore"):
        for r, j, s in best_pairs(rows, rows, metric, 12, True, 100):
            for a, b in zip(r, j):
                found.setdefault(int(a), []).append(ids[b])
        for q in np.random.default_rng(0).choice(700, 60, replace=False):
            s = -(x[q] * x).sum(1) if metric == "dot" else np.sqrt(((x[q] - x) ** 2).sum(1))
            here = [j for j in np.lexsort((ids, s)) if j % 40 != q % 40 and np.isfinite(s[j])]
            if kind != "odd":
                assert found[int(q)] == [ids[j] for j in here[:12]]


def test_single_precision_keeps_within_its_error():
    rng = np.random.default_rng(5)
    for offset, width in ((0, 3), (1e3, 64), (0, 500)):
        a, b = rng.normal(size=(50, width)) + offset, 3 * rng.normal(size=(60, width)) + offset
        for metric in ("euclidean", "dot"):
            short = ShortScores.of(a, b, metric)
            s, least, error = short.tile(slice(0, 50), slice(0, 60), np.zeros(50))
            want = -(a @ b.T) if metric == "dot" else ((a[:, None] - b[None]) ** 2).sum(2)
            assert np.abs(s - least[:, None] - want).max() <= error


@pytest.mark.parametrize("density", [0, 0.01, 0.5, 1])
def test_few_places_are_all_places(density):
    for shape in ((0, 5), (1, 1), (3, 5), (16, 16), (33, 31)):
        near = np.random.default_rng(1).random(shape) < density
        assert few_places(near).tolist() == np.flatnonzero(near).tolist()
        assert few_places(near[:, ::2]).tolist() == np.flatnonzero(near[:, ::2]).tolist()


@pytest.mark.parametrize("kind", ["plain", "copies", "nearer", "one_group"])
def test_kth_scores_of_many_slices(monkeypatch, kind):
    n, k, parts = 3000, 12, []
    real = np.partition
    monkeypatch.setattr(blocks, "TILE_VALUES", 1 << 14)
    monkeypatch.setattr(blocks.np, "partition", lambda a, kth, axis: parts.append(a.size) or real(a, kth, axis=axis))
    rng = np.random.default_rng(2)
    x, group = rng.normal(size=(n, 8)), np.arange(n) // 3
    if kind == "copies":
        x[::2] = 1.0
    elif kind == "nearer":  # each slice is nearer than all before
        x *= np.linspace(9, 1, n)[:, None]
    elif kind == "one_group":
        group[:2900] = -1
    asked = slice(n - 100, n)
    short = ShortScores.of(x[asked], x, "euclidean")
    got = short.kth(group[asked], group, k, True, 50)
    d = ((x[asked, None] - x[None]) ** 2).sum(2)
    d[group[asked, None] == group[None]] = np.inf
    assert np.abs(got - np.sort(d, 1)[:, k - 1]).max() <= short.error
    if kind == "plain":
        # Not all scores are partitioned, only those below the k-th so far.
        assert sum(parts) < 100 * n / 2


def ranks_by_hand(rows, asked):
    x = np.array([r[2] for r in rows])
    out = {}
    for item, entity, vec in asked:
        s = x @ np.array(vec)
        order = sorted((-s[j], rows[j][0], rows[j][1]) for j in range(len(rows)) if rows[j][0] != item)
        places = [i + 1 for i, o in enumerate(order) if o[2] == entity]
        out[item] = places[0] if places else None
    return out


@pytest.mark.parametrize("kind", ["plain", "copies", "hot"])
@pytest.mark.parametrize("values", [0, 10**6])
def test_query_ranks(spark, kind, values):
    rows = data(kind, 150) + [("z", "alone", [1.0] * 6)]
    df = frame(spark, rows)
    asked = df.filter("item like 'i00%' or item = 'z'")
    got = retrieval.query_ranks(df, asked, "item", "entity", "vec", broadcast_values=values,
                                layout=Layout(block_rows=20, cells=7))
    want = ranks_by_hand(rows, [r for r in rows if r[0].startswith("i00") or r[0] == "z"])
    assert {r["item"]: r["rank"] for r in got.collect()} == want


def test_probing_few_cells_is_approximate_and_cheaper(spark):
    draw = np.random.default_rng(2)
    rows = [(f"i{i:04d}", f"e{i}", v.tolist()) for i, v in enumerate(draw.normal(size=(600, 8)))]
    want, got = brute(rows, 10), {}
    for probe in (3, 20):
        layout = Layout(block_rows=100, cells=20, probe_cells=probe)
        near = found(neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", 10, layout=layout))
        got[probe] = sum(len(set(near[i]) & set(want[i])) for i in want) / 6000
    # All cells probed: exact again.
    assert got[20] == 1.0 and 0.5 < got[3] < 1.0


def clustered(n: int, width: int, clusters: int, seed=3):
    """Rows in clusters of very different sizes."""
    draw = np.random.default_rng(seed)
    centres = 6 * draw.standard_normal((clusters, width))
    which = np.minimum(draw.geometric(6 / clusters, n) - 1, clusters - 1)
    x = centres[which] + draw.standard_normal((n, width)) * draw.uniform(0.1, 0.6, clusters)[which][:, None]
    return [(f"i{i:05d}", f"e{i % 700}", v.tolist()) for i, v in enumerate(x)]


def copies(spark, rows, **layout):
    search = BlockSearch(neighbors.candidate_rows(frame(spark, rows), "item", "entity", "vec"), "euclidean",
                         Layout(block_rows=400, cell_rows=200, **layout))
    return search.copies(10, True)


def test_tree_and_kmeans_send_fewer_copies(spark):
    rows = clustered(6000, 8, 25)
    plain, kmeans, tree, both = (copies(spark, rows, **how) for how in (
        {}, {"refined": True}, {"tree": True}, {"tree": True, "refined": True}))
    print(f"copies of a row: pivots {plain:.2f}, k-means {kmeans:.2f}, tree {tree:.2f}, both {both:.2f}")
    assert tree < 0.8 * plain and kmeans < plain and both <= tree


def test_tree_of_balls_rules_out_nothing_that_is_near():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((900, 5)) + 8 * draw.standard_normal((12, 5))[draw.integers(0, 12, 900)]
    balls = Balls.over(x[:60], x[:400])
    group, cell, part = balls.place(x)
    assert (balls.cell_group[cell] == group).all() and (balls.part_cell[part] == cell).all()
    balls.part_radius, balls.group_radius = np.full(len(balls.parts), -1.0), np.full(len(balls.groups), -1.0)
    np.maximum.at(balls.part_radius, part, np.linalg.norm(x - balls.parts[part], axis=1))
    np.maximum.at(balls.group_radius, group, np.linalg.norm(x - balls.groups[group], axis=1))
    far = np.linalg.norm(x[:50, None] - x[None], axis=2)
    bound = np.sort(far, 1)[:, 9]
    met = np.zeros((50, 60), bool)
    for c, rows in balls.reached(x[:50], bound, lambda a, c, r: np.linalg.norm(a[:, None] - c[None], axis=2) - r - 1e-9):
        met[rows, c] = True
    wanted = np.zeros((50, 60), bool)
    for q, r in zip(*np.nonzero(far <= bound[:, None])):
        wanted[q, cell[r]] = True
    assert not (wanted & ~met).any() and met.sum() < 0.7 * met.size


def test_many_cells_need_no_fixed_limit():
    assert Layout().cells_for(10**9, 32) == 4096
    assert Layout(tree=True).cells_for(10**9, 32) == -(-10**9 // 16384)
    # Bounded by the bytes that go through the driver.
    assert Layout(tree=True).cells_for(10**12, 32) == 64 * 1024 * 1024 // 256


@pytest.mark.parametrize("width", [8, 32])
def test_hashing_finds_nine_of_ten(spark, width):
    rows = clustered(3000, width, 40, seed=width)
    made = knn_by_hashing(frame(spark, rows), "item", "entity", "vec", 10, part_rows=150)
    want, near = brute(rows, 10), found(made)
    hit = sum(len({i for i, _ in near.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    assert hit >= 0.9 * 10 * len(rows)
    by_item = {r[0]: np.array(r[2]) for r in rows}
    for q, edges in list(near.items())[:200]:
        assert [d for _, d in edges] == sorted(d for _, d in edges) and len(edges) <= 10
        assert all(d == pytest.approx(np.linalg.norm(by_item[q] - by_item[i]), abs=1e-8) for i, d in edges)


def test_hashing_of_hot_buckets_and_odd_rows(spark):
    rows = data("hot_copies", 300) + [("z", None, [4.0] * 6), ("y", None, [4.0] * 6)]
    exact = brute(rows, 5)
    near = found(knn_by_hashing(frame(spark, rows), "item", "entity", "vec", 5, tables=1, bits=1, part_rows=40))
    for q, edges in near.items():
        assert len(edges) <= 5 and all(d >= exact[q][0][1] for _, d in edges)
    # Equal vectors share every bucket: the copies of other entities, smallest ids first.
    assert near["z"] == exact["z"] and "y" not in {i for i, _ in near["z"]}
    with pytest.raises(ValueError):
        knn_by_hashing(frame(spark, rows).limit(0), "item", "entity", "vec")


@pytest.mark.parametrize("kind", ["plain", "copies", "hot_copies", "no_entity"])
@pytest.mark.parametrize("exclude", [True, False])
def test_large_buckets_and_blocks_find_the_same(spark, monkeypatch, kind, exclude):
    rows = frame(spark, data(kind, 300))
    near = []
    for least in (0.0, np.inf):
        monkeypatch.setattr(lsh, "ONCE_PAIRS", least)
        made = knn_by_hashing(rows, "item", "entity", "vec", 5, tables=4, bits=3, exclude_group=exclude, part_rows=20)
        near.append({(r["item"], r["neighbor_item"], r["rank"], r["entity"], r["neighbor_entity"], r["distance"]) for r in made.collect()})
    assert near[0] == near[1] and len(near[0]) > 1000


def test_few_bits_compare_each_pair_once(spark, monkeypatch):
    n, k, tables, compared = 2000, 10, 24, spark.sparkContext.accumulator(0)
    x = np.random.default_rng(0).normal(size=(n, 16))
    rows = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(x)], "item int, entity int, vec array<double>")

    def counted(q, c, *rest):
        compared.add(len(q) * len(c))
        return best_pairs(q, c, *rest)

    monkeypatch.setattr(lsh, "best_pairs", counted)
    made = found(knn_by_hashing(rows, "item", "entity", "vec", k, tables=tables, bits=4, part_rows=100))
    assert len(made) == n and all(len(v) == k for v in made.values())
    assert compared.value == n * n


@pytest.mark.parametrize("width", [8, 32])
def test_recall_of_probed_cells(spark, width):
    rows = clustered(3000, width, 40, seed=width)
    layout = Layout(block_rows=200, cells=30, probe_cells=6)
    near, want = found(neighbors.knn_exclude_group(frame(spark, rows), "item", "entity", "vec", 10, layout=layout)), brute(rows, 10)
    assert sum(len({i for i, _ in near[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(rows)


def test_queries_are_chosen_without_vectors(spark):
    rows = frame(spark, data("plain", 200))
    got = retrieval.retrieval_queries(rows, "entity", "item", 2, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("vec" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    ids = retrieval.retrieval_queries(rows.select("entity", "item"), "entity", "item", 2, 20)
    assert sorted(r.item for r in got.collect()) == sorted(r.item for r in ids.collect()) and got.columns == rows.columns


def test_many_narrow_queries_in_little_memory():
    n = 100_000
    draw = np.random.default_rng(0)
    ids, groups = np.arange(n), np.arange(n) % 5000
    vec = draw.normal(size=(n, 16))
    q = {"id": ids.tolist(), "grp": groups.tolist(), "vec": vec}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids[:64]), pa.array(groups[:64]), pa.array(vec[:64].tolist())], names=["id", "grp", "vec"])
    tracemalloc.start()
    made = list(retrieval._stream(_Sent(cloudpickle.dumps(q)), retrieval._best_step)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert sum(b.num_rows for b in made) > 1000


class _Sent:
    def __init__(self, value):
        self.value = value


def test_recall(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 7), ("c", None), ("d", 40)], "item string, rank bigint")
    got = {r.k: r.recall for r in retrieval.recall_at_k(ranks, 30, (1, 10, 100)).collect()}
    assert got == {1: 0.25, 10: 0.5, 100: 0.5}
    empty = retrieval.recall_at_k(ranks.limit(0), 30).collect()
    assert all(np.isnan(r.recall) and r.query_count == 0 for r in empty)
    assert all(np.isnan(r.recall) for r in retrieval.recall_at_k(ranks, 1).collect())
    none = retrieval.retrieval_queries(frame(spark, [("a", "e", [1.0])]), "entity", "item")
    assert none.count() == 0


def lists(spark, *distances):
    rows = [(f"a{i}", "e", [(j + 1, float(x), f"n{j}", "f") for j, x in enumerate(ds)])
            for i, ds in enumerate(distances)]
    return spark.createDataFrame(
        rows, "item string, entity string, neigh array<struct<rank:int,dist:double,item:string,entity:string>>")


def test_local_scale(spark):
    df = neighbors.local_scale(lists(
        spark, [1, 2, 3, 4], [1, 2], [], [0, 0, 0, 5], [0, 0, 0], [0, 3, 4]), k0=3)
    got = [(r.local_scale, r.short) for r in df.orderBy("item").collect()]
    assert got == [(3.0, False), (2.0, True), (1.0, True), (5.0, False), (1.0, False), (4.0, False)]
    with pytest.raises(ValueError):
        neighbors.check_neighbor_options(50, 50)


def test_bands(spark):
    df = neighbors.local_scale(lists(spark, [1, 2, 3, 4], []), k0=2)
    banded = neighbors.assign_bands(df, [0.5, 1.0, 1.4, 1.5, 1.6, 2.5])
    assert [r.bands for r in banded.orderBy("item").collect()] == [[1, 2, 4, 5], []]
    edges = neighbors.calibrate_bands(df, "item")
    want = np.percentile(np.array([0.5, 1, 1.5, 2], np.float32), [5, 10, 20, 40, 60, 85]).astype(np.float32)
    assert edges == [float(x) for x in want]


def test_table_keeps_parameters(spark, tmp_path):
    df = neighbors.assign_bands(neighbors.local_scale(lists(spark, [1, 2])), [1.0])
    neighbors.difficulty_rows(df, "item", {"neighbors": 150}).write.parquet(str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert tuple(back.columns) == neighbors.DIFFICULTY_COLUMNS
    assert back.schema["target_coord_hash"].metadata == {"neighbors": "150"}
    assert back.first().neighbor_building_ids == ["f", "f"]


def test_pca_against_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 10)) * np.arange(1, 11)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i int, v array<double>")
    out, explained = neighbors.pca_reduce(df, "v", 4)
    got = np.array([r.features for r in out.orderBy("i").collect()])
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(c @ vt[:4].T), abs=1e-8)
    assert explained == pytest.approx((s[:4] ** 2).sum() / (s**2).sum())


@pytest.mark.parametrize("layout", [Layout(block_rows=32, cells=24), Layout(block_rows=32, cells=24, parts=4, tree=True),
                                    Layout(block_rows=32, cells=24, parts=10, refined=True), Layout(block_rows=100, cells=7)])
def test_copies_of_a_row_do_not_follow_the_table(spark, layout):
    rng = np.random.default_rng(2)
    rows = [(f"i{i:05d}", f"e{i % 25}", [float(v) for v in rng.standard_normal(16)]) for i in range(3000)]
    for n in (1500, 3000):
        made = frame(spark, rows[:n]).select(F.col("item").alias("id"), F.col("entity").alias("grp"), F.col("vec"))
        assert BlockSearch(made, "euclidean", layout).copies(10, True) <= 24 + 16
