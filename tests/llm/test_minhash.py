"""Near duplicates against all pairs, and signatures against the plain algorithm."""

import numpy as np
import pytest

from corpora import docs_of, edges, empty, prose
from entityvec.llm import minhash
from entityvec.llm.arrays import GOLDEN, mix64
from entityvec.llm.components import components


def plain_superminhash(elements, slots):
    """One set, one shingle after the other, with whole permutations."""
    best = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    for e in elements:
        order = list(range(slots))
        for rank in range(slots):
            draw = int(mix64(np.array([int(e) + (rank + 1) * GOLDEN & (1 << 64) - 1], np.uint64))[0])
            j = rank + ((draw >> 32) * (slots - rank) >> 32)
            order[rank], order[j] = order[j], order[rank]
            best[order[rank]] = min(int(best[order[rank]]), rank << 32 | draw & 0xFFFFFFFF)
    return best


def test_signature_equals_plain_algorithm():
    draw = np.random.default_rng(1)
    sets = [draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    owner = np.repeat(np.arange(5), [len(s) for s in sets])
    got = minhash.superminhash(np.concatenate(sets), owner, 6, 24)
    for i, s in enumerate(sets):
        assert (got[i] == plain_superminhash(s, 24)).all()
    assert (got[5] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_signatures_do_not_depend_on_what_is_held_together(monkeypatch):
    draw = np.random.default_rng(8)
    sizes = draw.integers(0, 400, 60)
    element, owner = draw.integers(0, 1 << 63, sizes.sum()).astype(np.uint64), np.repeat(np.arange(60), sizes)
    whole = minhash.superminhash(element, owner, 60, 360)
    monkeypatch.setattr(minhash, "ELEMENTS", 100)
    assert (minhash.superminhash(element, owner, 60, 360) == whole).all()


@pytest.mark.parametrize("union", [8, 100, 1000])
def test_variance_of_estimates(union):
    slots, share, tries = 120, 0.75, 400
    draw = np.random.default_rng(union)
    equal = []
    for _ in range(tries):
        every = draw.integers(0, 1 << 63, union).astype(np.uint64)
        both, cut = int(union * share), int(union * (1 + share) / 2)
        a, b = every[:cut], np.concatenate([every[:both], every[cut:]])
        sets = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, slots)
        equal.append((sets[0] == sets[1]).sum())
    want = slots * share * (1 - share) * minhash.variance_factor(slots, union)
    assert abs(np.mean(equal) - slots * share) < 4 * np.sqrt(want / tries)
    assert 0.75 * want < np.var(equal) < 1.3 * want


def brute(rows, percent=75):
    sets = [(i, minhash._sets(t or "", 5)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a & b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def got(frame):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame).collect()), key=str)


def variants(seed, copies, share):
    """Texts around the threshold: a base with some words replaced."""
    base = prose(seed, 120).split()
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(copies):
        words = list(base)
        for at in draw.choice(120, int(draw.integers(0, share)), replace=False):
            words[at] = "new" + str(draw.integers(1000))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [4096, 8])
def test_equals_all_pairs_around_the_threshold(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = variants(3, 60, 14) + variants(4, 40, 4) + [prose(9, n) for n in (1, 3, 4, 5, 6, 50)] + [prose(9, 4).upper()]
    frame = docs_of(spark, [((i * 37) % len(texts), t) for i, t in enumerate(texts)])
    assert got(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])


def test_edge_cases(spark):
    frame = edges(spark)
    assert got(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])
    assert got(empty(spark)) == []


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(chain, "a bigint, b bigint").repartition(7)
    found = {r.node: r.component for r in components(frame).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(frame.limit(0)).collect() == []
