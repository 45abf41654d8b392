"""Targets by water-filling, nearness of the mix, stability, and awkward tables."""

from collections import defaultdict
from fractions import Fraction

import pytest

from corpora import SCHEMA, edges, empty, prose
from entityvec.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(percent * sum(sizes.values()), 100), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        shares = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else Fraction(rest * weight[s], shares) for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return {s: float(t) for s, t in target.items()}
        capped |= above


@pytest.mark.parametrize("cells", [4096, 3])
def test_every_source_comes_near_its_target(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rows = [(i, prose(i, 3 + i * 7 % 90), "en", ["a", "b", "c", "d", None][i % 11 % 5], 0) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.pareto_mix(frame).collect()
    source = {r[0]: r[3] for r in rows}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    want = plain_targets(sizes)
    assert len(got) == 400
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest[s] / 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.pareto_mix(frame.repartition(5)).collect()))


def test_inclusion_follows_the_fraction(spark):
    rows = [(i, "w", "en", "a" if i < 300 else "b", 1) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    total = [0, 0]
    for seed in range(3):
        got = mixing.pareto_mix(frame, weights=(3, 1), percent=80, seed=seed).collect()
        for r in got:
            total[r.doc_id >= 300] += r.taken
    # 480 words: 360 and 120.
    assert total == [3 * 360, 3 * 120]


def test_edge_cases(spark):
    got = mixing.pareto_mix(edges(spark)).collect()
    assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.pareto_mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 1)], SCHEMA)
    assert sorted(tuple(r) for r in mixing.pareto_mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
