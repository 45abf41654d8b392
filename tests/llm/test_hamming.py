"""Multi-index hashing: the pigeonhole, exactness where all rows are within reach, and recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityvec.llm import hamming

SCHEMA = "vec_id bigint, embedding array<float>, id string, code bigint, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], "x", 3, None) for i, v in rows], SCHEMA)


def usable(rows):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            out[i] = min(out.get(i, v), v)
    widths = [len(v) for v in out.values()]
    width = min(set(widths), key=lambda w: (-widths.count(w), w), default=0)
    return {i: np.array(v) for i, v in out.items() if len(v) == width}


def brute(rows, k, every):
    kept = usable(rows)
    out = []
    for q, a in kept.items():
        if q % every == 0:
            near = sorted((-float((a * b).sum()), i) for i, b in kept.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


def got(frame, k=20, every=20):
    return sorted(tuple(r) for r in hamming.nearest_by_codes(frame, F.col("id") % every == 0, k=k).collect())


def vectors(seed, n, width, clusters=0):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, width))
    if clusters:
        x = 4 * draw.standard_normal((clusters, width))[draw.integers(0, clusters, n) * (draw.random(n) < 0.7).astype(int)] + 0.3 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 20, 63, 127, 128])
def test_codes_within_the_radius_are_near_in_a_substring(radius):
    codes = hamming.Codes(vectors(1, 300, 16))
    draw = np.random.default_rng(2)
    whole = draw.integers(0, 2, (400, 128))
    other = whole.copy()
    for row in other:
        at = draw.choice(128, draw.integers(0, radius + 1), replace=False)
        row[at] ^= 1
    starts = np.append(0, np.cumsum(codes.sizes))
    far = np.stack([(whole != other)[:, a:b].sum(1) for a, b in zip(starts[:-1], starts[1:])], 1)
    assert ((whole != other).sum(1) <= radius).all() and (far <= np.array(codes.radii(radius))).any(1).all()


def test_codes_hold_the_signs_and_masks_the_small_numbers():
    x = vectors(3, 500, 24)
    codes = hamming.Codes(x)
    made = codes.encode(x[:50])
    bits = np.hstack([(made[:, i][:, None] >> np.arange(n, dtype=np.uint64)[::-1]) & np.uint64(1) for i, n in enumerate(codes.sizes)])
    assert (bits == ((x[:50] - codes.mean) @ codes.turn >= 0)).all() and bits.shape == (50, 128)
    for radius in (-1, 0, 1, 3, 5, 9):
        assert sorted(hamming._masks(5, radius)) == [m for m in range(32) if m.bit_count() <= radius]


def test_awkward_rows(spark):
    rows = [(i, v) for i, v in zip(range(0, 24), vectors(4, 24, 8))]
    rows += [(20, None), (40, [0.0] * 8), (60, []), (80, [1.0] * 7 + [None]), (100, [math.nan] + [1.0] * 7), (None, [1.0] * 8),
             (120, [math.inf] * 8), (140, [1.0, 2.0]), (160, list(rows[3][1])), (161, list(rows[3][1])), (7, list(rows[9][1])),
             (180, list(rows[3][1])), (180, list(rows[3][1]))]
    frame = table(spark, rows)
    # No query has more than 27 others, so all are found however far they are.
    assert got(frame, k=40) == brute(rows, 40, 20)
    assert got(frame.filter("vec_id = 0")) == got(frame.limit(0)) == got(frame.filter("vec_id = 1 or vec_id = 2")) == []


@pytest.mark.parametrize("clusters", [0, 6])
def test_recall_in_many_shards(spark, monkeypatch, clusters):
    monkeypatch.setattr(hamming, "SHARD_ROWS", 200)
    monkeypatch.setattr(hamming, "SHARD_QUERIES", 40)
    x = vectors(5, 3000, 32, clusters)
    x[700:1000] = x[700]
    rows = list(enumerate(x))
    want, made = brute(rows, 10, 25), got(table(spark, rows).repartition(4), 10, 25)
    assert [r[:2] for r in made] == [r[:2] for r in want]
    scores = {(q, i): s for q, _, i, s in made}
    kept = usable(rows)
    assert all(s == pytest.approx(float(kept[q] @ kept[i]), abs=1e-12) for (q, i), s in scores.items())
    # Among equal vectors any choice but that of the smallest ids would be a miss.
    assert len(scores.keys() & {(q, i) for q, _, i, _ in want}) >= 0.93 * len(want)


def test_a_small_radius_grows_until_every_query_is_served(spark, monkeypatch):
    monkeypatch.setattr(hamming, "_radius", lambda *a: 0)
    rows = list(enumerate(vectors(6, 400, 16)))
    made = got(table(spark, rows), 5, 20)
    assert [r[:2] for r in made] == [r[:2] for r in brute(rows, 5, 20)]
