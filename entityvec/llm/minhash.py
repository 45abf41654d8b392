"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

A signature slot holds the least ``rank + fraction`` that any shingle of the document puts
there; each shingle visits the slots in the order of its own random permutation, so no two
of its ranks share a slot (SuperMinHash). Ranks are taken one at a time for all shingles of
a batch, and a document stops as soon as no later rank can lower one of its slots.

With ``BANDS`` bands of ``ROWS`` slots, two documents of similarity 0.75 share no band with
a chance of 8e-6. Pairs are compared on their sketches (four bits of each slot), which pass
a similarity of 0.75 but for a chance of 3e-5, and confirmed on the full shingle sets.
"""

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import written
from entityvec.llm.arrays import (
    GOLDEN, chunks, mix64, shingle_hashes, text_bytes, word_hashes, words)
from entityvec.llm.components import components

BANDS, ROWS, SHINGLE = 60, 6, 5
#: Ranks for which slots are traced back through the swaps; later ones use permutations.
TRACED = 8
#: Elements whose permutations are held at once (2 bytes a slot), and texts signed together.
ELEMENTS, TEXTS = 1 << 14, 1 << 10
#: Members of a tile; larger buckets are cut into tiles, and each two of them are compared in a group of their own.
TILE = 4096
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(element: np.ndarray, owner: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """(rows, slots) signatures of ``rows`` sets of 64-bit elements; ``owner`` is ascending.

    Slots of an empty set hold the largest value. Sets are taken together up to ``ELEMENTS`` of
    them in all, so the permutations' memory is bounded; a larger set is done before it needs them.
    """
    best = np.full((rows, slots), _FULL, np.uint64)
    # Sets of like sizes together: the smaller a set, the more ranks it takes.
    sizes = np.bincount(owner, minlength=rows)
    order = np.argsort(sizes, kind="stable")
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    moved = np.argsort(place[owner], kind="stable")
    element, owner, ends = element[moved], place[owner][moved], np.cumsum(sizes[order])
    row = done = 0
    while done < len(element):
        last = max(int(np.searchsorted(ends, done + ELEMENTS, side="right")), row + 1)
        end, some = int(ends[last - 1]), order[row:last]
        best[some] = _filled(element[done:end], owner[done:end] - row, len(some), slots)
        row, done = last, end
    return best


def _filled(element: np.ndarray, owner: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """Signatures of some sets, one rank of all elements after the other.

    A slot filled at an earlier rank lies below all later ones, so only free slots are looked at,
    and a set is done when none is left; more ranks would change nothing.
    """
    best = np.full((rows, slots), _FULL, np.uint64)
    flat = best.reshape(-1)
    swaps: list[np.ndarray] = []
    permutation = None
    for rank in range(slots):
        if not len(element):
            break
        draw = mix64(element + np.uint64((rank + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        chosen = rank + (((draw >> np.uint64(32)) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        if rank < TRACED:
            place = chosen
            for i in range(rank - 1, -1, -1):
                place = np.where(swaps[i] == place, i, place)
            swaps.append(chosen)
        else:
            index = np.arange(len(element))
            if permutation is None:
                permutation = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
                for i, swap in enumerate(swaps):
                    moved = permutation[index, swap]
                    permutation[index, swap] = permutation[:, i]
                    permutation[:, i] = moved
                swaps = []
            place = permutation[index, chosen].astype(np.int64)
            permutation[index, chosen] = permutation[:, rank]
        spot = owner * slots + place
        open_ = np.flatnonzero(flat[spot] == _FULL)
        spot = spot[open_]
        np.minimum.at(flat, spot, np.uint64(rank << 32) | (draw[open_] & np.uint64(0xFFFFFFFF)))
        if rank >= TRACED and rank % 8:
            continue
        keep = (best == _FULL).any(axis=1)[owner]
        if not keep.all():
            element, owner = element[keep], owner[keep]
            swaps = [s[keep] for s in swaps]
            if permutation is not None:
                permutation = permutation[keep]
    return best


def _sets(text: str, size: int) -> set:
    found = text.encode("utf-8").lower().split()
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*[found[i:] for i in range(size)]))


def _signer(bands: int, rows: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for start, end in chunks(offsets, 1 << 19, TEXTS):
                at = offsets[start:end + 1] - offsets[start]
                part, count = data[offsets[start]:offsets[end]], end - start
                first, last = words(part, at)
                row = np.searchsorted(at, first, side="right") - 1
                owner, shingle = shingle_hashes(word_hashes(part, first, last), row, count, size)
                slots = superminhash(shingle, owner, count, bands * rows).reshape(count, bands, rows)
                key = np.zeros((count, bands), np.uint64)
                for i in range(rows):
                    key = mix64(key + slots[:, :, i] + np.uint64(GOLDEN))
                key = mix64(key ^ np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN))
                n = np.bincount(owner, minlength=count)
                ends = np.cumsum(n)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(shingle ^ np.uint64(s)))])
                         for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                digest = [(t[ends] - t[ends - n]).view(np.int64) for t in total]
                where = np.arange(count + 1, dtype=np.int32) * bands
                bits = (mix64(slots) & np.uint64(15)).astype(np.uint8).reshape(count, -1)
                sketch = bits[:, 0::2] * np.uint8(16) + bits[:, 1::2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, count), pa.array(n, pa.int64()),
                     *[pa.array(d, pa.int64()) for d in digest],
                     pa.ListArray.from_arrays(where, pa.array(key.view(np.int64).reshape(-1))),
                     pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])
    return sign


def _confirmer(percent: int, size: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, known, sets = [], None, set()
            for a, b in zip(batch.column(2), batch.column(3)):
                if (left := a.as_py()) != known:
                    known, sets = left, _sets(left, size)
                other = _sets(b.as_py(), size)
                shared = len(sets & other)
                good.append(100 * shared >= percent * (len(sets) + len(other) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])
    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """``pairs`` (a, b) whose full shingle sets are similar enough."""
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    there = texts.join(sent_if_small(wanted), "doc_id", "left_semi")
    full = (pairs.join(there.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(there.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))
    checked = full.mapInArrow(_confirmer(percent, size), "a bigint, b bigint, good boolean")
    return written(checked.filter("good").select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B| for their sets of
    distinct ``size``-word shingles. ``component_id`` is the smallest doc_id reachable by
    links, and ``kept`` marks the row that bears it.

    A null, empty or blank text has the empty set and no links. A text of fewer words is one
    shingle. Long texts are read whole, with arrays of some 50 times one text's bytes. Rows without doc_id stay apart: component_id is null and kept true. Rows that
    share a doc_id are one document with several texts; n_shingles is each row's own. An empty table
    gives an empty result. Columns other than doc_id and text are not read.

    Documents of equal sets are grouped first, and only the smallest goes on. In each bucket
    of a band every member is compared with the smallest and the largest one; then members of a bucket that
    are still in different components are compared with each other.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    signed = written(texts.mapInArrow(
        _signer(bands, rows, size),
        T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                      T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
                      T.StructField("bands", T.ArrayType(T.LongType())),
                      T.StructField("sketch", T.BinaryType())])), "signatures")
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    # Written first, here and below: next to an aggregate of its own key a join cannot split a hot one.
    groups = written(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "groups")
    members = written(usable.select("doc_id", "d1", "d2").join(groups, ["d1", "d2"])
                      .select("doc_id", "rep").distinct(), "members")
    reps = members.filter("doc_id = rep").select("doc_id")
    banded = (usable.join(reps, "doc_id", "left_semi")
              .select("doc_id", F.posexplode("bands").alias("band", "key")))
    least = written(banded.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
                    .filter("a <> z").select("band", "key", "a", "z"), "buckets")
    crowded = written(banded.join(least, ["band", "key"]), "crowded")
    owners = written(members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("texts")), "owners")
    # Copies follow their representative; only a doc_id with several texts is a link of its own.
    several = owners.filter("texts > 1").select("doc_id")
    same = (members.join(several, "doc_id", "left_semi").filter("doc_id <> rep")
            .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    stars = (crowded.filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
             .union(crowded.filter("doc_id <> a and doc_id <> z").select(F.col("doc_id").alias("a"), F.col("z").alias("b")))
             .distinct())
    links = _confirmed(stars, texts, percent, size)
    found = written(components(links), "components")
    rest = _confirmed(_rest(crowded, found, usable, percent, bands * rows), texts, percent, size)
    all_links = links.union(rest).union(same)
    named = written(components(all_links), "components")
    placed = owners.join(named.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component"))
    return (signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def variance_factor(slots: int, union: int) -> float:
    """Variance of a SuperMinHash estimate over that of MinHash, for a pair with so many shingles in all.

    About one half while the union is smaller than the signature, and 1 in the limit.
    """
    if union < 2:
        return 0.0
    n = np.arange(1, slots, dtype=np.float64)
    base = union * np.log(n) - (union - 1) * math.log(slots - 1) - union * math.log(slots)
    with np.errstate(divide="ignore"):
        rise, fall = union * np.log(n + 1), union * np.log(n - 1)
    return float(1 - (np.exp(base + rise) + np.exp(base + fall) - 2 * np.exp(base + union * np.log(n))).sum() / (union - 1))


def least_matches(percent: int, slots: int, union: int) -> float:
    """Equal sketch cells that a pair of exactly ``percent`` has but for four standard deviations."""
    share, chance = percent / 100, 1 / 16
    equal = slots * share * (1 - share) * variance_factor(slots, union)
    spread = equal * (1 - chance) ** 2 + slots * (1 - share) * chance * (1 - chance)
    return slots * (share + (1 - share) * chance) - 4 * math.sqrt(spread)


def _compared(percent: int, slots: int):
    """Pairs of a group's buckets that may be similar, each in the first band that they share."""
    zero = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)
    # The bound falls with the union; each size takes that of the next larger step.
    steps = np.unique(np.append(np.geomspace(2, 64 * slots, 100).astype(np.int64), 1))
    bounds = np.append([least_matches(percent, slots, int(u)) for u in steps], least_matches(percent, slots, 1 << 24))

    def compare(group: pa.Table) -> pa.Table:
        band, key, low, high, tile, doc, comp, n = (
            group.column(i).to_numpy() for i in range(1, 9))
        order = np.lexsort((doc, high, low, key, band))
        group = group.take(pa.array(order))
        band, key, low, high, tile, doc, comp, n = (x[order] for x in (band, key, low, high, tile, doc, comp, n))
        sketch = np.frombuffer(b"".join(group.column(9).to_pylist()), np.uint8).reshape(len(doc), -1)
        keys = np.vstack([np.asarray(x) for x in group.column(10).combine_chunks().flatten().to_numpy(
            zero_copy_only=False).reshape(len(doc), -1)])
        fresh = np.ones(len(doc), bool)
        fresh[1:] = ((band[1:] != band[:-1]) | (key[1:] != key[:-1])
                     | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        starts = np.append(np.flatnonzero(fresh), len(doc))
        left, right = [], []
        for start, end in zip(starts[:-1], starts[1:]):
            apart = low[start] != high[start]
            for i in range(start, end - 1):
                j = np.arange(i + 1, end)
                small, large = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
                good = (comp[j] != comp[i]) & (doc[j] != doc[i]) & (100 * small >= percent * large)
                if apart:
                    good &= tile[j] != tile[i]
                j = j[good]
                if len(j):
                    # At the threshold the union has (|A| + |B|) / (1 + similarity) shingles.
                    union = (n[j] + n[i]) * 100 // (100 + percent) + 1
                    j = j[zero[sketch[j] ^ sketch[i]].sum(axis=1) >= bounds[np.searchsorted(steps, union)]]
                if len(j):
                    # The first band that the two share; others give the pair elsewhere.
                    j = j[(keys[j] == keys[i]).argmax(axis=1) == band[i]]
                    left.append(np.full(len(j), doc[i]))
                    right.append(doc[j])
        pair = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
        return pa.table({"a": pa.array(pair[0], pa.int64()), "b": pa.array(pair[1], pa.int64())})
    return compare


def _rest(crowded: DataFrame, found: DataFrame, signed: DataFrame, percent: int, slots: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and have like sketches.

    A bucket is dealt into tiles of about ``TILE`` members; every two tiles, and each by itself, are a
    cell, so all pairs are compared once and no task has more than some cells.
    """
    labelled = (crowded.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .select("band", "key", "doc_id", F.coalesce("component", "doc_id").alias("comp")))
    labelled = written(labelled, "labelled")
    mixed = written(labelled.groupBy("band", "key")
                    .agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_n"))
                    .filter("_low <> _high").select("band", "key", "_n", F.ceil(F.col("_n") / TILE).cast("int").alias("_tiles")), "mixed-buckets")
    dealt = (labelled.join(mixed, ["band", "key"])
             .withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("_tiles")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
             .select("band", "key", F.least("tile", "_other").alias("low"), F.greatest("tile", "_other").alias("high"), "tile", "doc_id", "comp"))
    cells = dealt.join(signed.select("doc_id", "n_shingles", "sketch", "bands"), "doc_id").filter("get(bands, band) = key")
    groups = max(1, (mixed.agg(F.sum(F.col("_n") * F.col("_tiles"))).first()[0] or 0) // TILE)
    return (cells.withColumn("g", F.pmod(F.xxhash64("band", "key", "low", "high"), F.lit(groups)))
            .select("g", "band", "key", "low", "high", "tile", "doc_id", "comp", "n_shingles", "sketch", "bands")
            .groupBy("g").applyInArrow(_compared(percent, slots), "a bigint, b bigint").distinct())
