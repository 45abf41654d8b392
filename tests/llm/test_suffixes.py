"""Removed bytes against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from corpora import SCHEMA, edges, empty, prose
from entityvec.llm.suffixes import _Block, cut_repetitions, least_owner, multikey_order


def brute(rows, width=50):
    first = {}
    order = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    for i, t in zip(order, texts):
        for p in range(len(t) - width + 1):
            s = t[p:p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for (doc, _), i, t in zip(rows, order, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first[t[p:p + width]] < i:
                gone[p:p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame, **kw):
    return sorted((tuple(r) for r in cut_repetitions(frame, **kw).collect()), key=str)


def test_multikey_order_sorts():
    symbols = np.random.default_rng(1).integers(0, 3, (500, 5)).astype(np.uint64)
    order, group = multikey_order(symbols)
    rows = [tuple(r) for r in symbols[order]]
    assert rows == sorted(map(tuple, symbols))
    assert [a == b for a, b in zip(rows, rows[1:])] == (group[1:] == group[:-1]).tolist()


@pytest.mark.parametrize("block_bytes", [1 << 30, 6000])
@pytest.mark.parametrize("width", [50, 40])
def test_equals_all_strings(spark, block_bytes, width):
    draw = random.Random(5)
    parts = [prose(i, 12) for i in range(12)] + ["ab" * 60, "x" * 130, "é" * 70, prose(99, 12)[:50], prose(98, 12)[:49]]
    rows = []
    for i in range(70):
        picked = [draw.choice(parts)[draw.choice([0, 0, 3]):] for _ in range(draw.randint(0, 5))]
        rows.append(((i * 29) % 71, draw.choice(["", "-", str(i)]).join(picked), "en", "a", 0))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame, width=width, block_bytes=block_bytes) == brute([r[:2] for r in rows], width)


@pytest.mark.parametrize("bucket_blocks", [1, 2])
def test_blocks_of_a_bucket_do_not_matter(spark, bucket_blocks):
    rows = [(i, prose(i % 9, 30) + str(i) + prose(i % 5, 14)) for i in range(40)]
    frame = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert got(frame, block_bytes=3000, bucket_blocks=bucket_blocks) == brute(rows)


@pytest.mark.parametrize("buckets", [1, 3, 1000, 1_250_000])
def test_cuts_are_equal_ranges_of_hashes(buckets):
    block = _Block.__new__(_Block)
    block.short = np.unique(np.random.default_rng(buckets).integers(0, 1 << 48, 5000).astype(np.uint64))
    cuts = block.cuts(buckets)
    assert cuts[0] == 0 and cuts[-1] == 5000 and len(cuts) == buckets + 1
    owner = np.repeat(np.arange(buckets), np.diff(cuts))
    assert owner.tolist() == [int(h) * buckets >> 48 for h in block.short]


@pytest.mark.parametrize("compared", [1, 7, 1 << 16])
def test_owners_of_an_anchor_with_many_surroundings(compared):
    draw = np.random.default_rng(3)
    reach, n = 18, 400
    left, right = draw.integers(0, reach + 1, n), draw.integers(0, reach + 1, n)
    full = np.zeros((n, 32 + 2 * reach + 2), np.uint8)
    full[:, reach:reach + 32] = draw.integers(0, 2, n)[:, None]
    for r in range(n):
        full[r, reach - left[r]:reach] = draw.integers(0, 2, left[r])
        full[r, reach + 32:reach + 32 + right[r]] = draw.integers(0, 2, right[r])
    full[:, -2], full[:, -1] = left, right
    rank = draw.permutation(n)
    strings = [(r, o, full[r, reach - o:reach - o + 50].tobytes())
               for r in range(n) for o in range(reach + 1) if left[r] >= o and right[r] >= reach - o]
    want = np.full((n, reach + 1), n)
    places = {}
    for r, o, s in strings:
        places[o, s] = min(places.get((o, s), n), rank[r])
    for r, o, s in strings:
        want[r, o] = places[o, s]
    assert (least_owner(full, rank, n, 50, compared) == want).all() and (want < n).any()


def test_edge_cases(spark):
    rows = [(r.doc_id, r.text) for r in edges(spark).collect()]
    assert got(edges(spark)) == brute(rows)
    assert got(edges(spark), block_bytes=1 << 15) == brute(rows)
    assert got(empty(spark)) == []


def test_kept_texts(spark):
    passage = prose(7, 20)
    frame = spark.createDataFrame([(1, passage, "en", "a", 0), (2, "start " + passage + "!", "en", "a", 0)], SCHEMA)
    kept = {r.doc_id: bytes(r.kept).decode() for r in cut_repetitions(frame, texts=True).collect()}
    assert kept == {1: passage, 2: "start !"}
