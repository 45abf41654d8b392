"""Removal of long byte strings that also start in an earlier document, by sorted suffixes.

Every 50-byte string has an anchor: the 32 bytes inside it with the least hash. Equal
strings have equal anchors at equal places, so only the suffixes that start at anchors need
to be sorted, each with the bytes before it that one of its strings can reach.

1. Blocks of documents send the hashes of their anchors, and learn which of them another
   block has too. No other anchor can be part of a repetition.
2. For these the suffixes are range-partitioned by their leading bytes at sampled splitters.
   Each bucket sorts its suffixes by multikey quicksort on 8-byte symbols, then compares
   neighbours byte by byte to both sides, and tells each block the least doc_id of every string.
   Splitters see the anchor alone, so equal suffixes never lie on two sides of a boundary.
3. Blocks mark and cut the bytes of their documents.

A block sends each distinct suffix once, however many of its documents have it.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityvec.llm.arrays import GOLDEN, chunks, mix64, text_bytes

WIDTH, ANCHOR = 50, 32
#: Bytes of text in a block; a longer document is in a block with few others.
BLOCK_BYTES = 8 << 20
#: Blocks of text for each bucket of hashes; buckets of suffixes are half as large. A block sends at most one message to a bucket, and none without an anchor in it.
BUCKET_BLOCKS = 4
#: Suffixes that are compared at once; all of one anchor, if it has more.
COMPARED = 1 << 16
#: Splitters at most; finer buckets are cut by the hash of the anchor.
SPLITTERS = 4096
SAMPLED_DOCS, SAMPLED_EACH = 8192, 32
LAST = np.iinfo(np.int64).max


def _rolled(x: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` of each ``span`` consecutive values, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _anchor_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors, ascending, and the hashes of their bytes."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = data.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN)
    have = 1
    while have < ANCHOR:
        h = h[:-have] * np.uint64(0xD1342543DE82EF95 + 2 * have) + h[have:]
        h ^= h >> np.uint64(29)
        have *= 2
    h = mix64(h) | np.uint64(1)
    span = width - ANCHOR + 1
    least = _rolled(h, span, np.minimum)
    # Strings that would cross the end of a document have no anchor.
    ends = offsets[1:]
    open_ = np.zeros(len(data) + 1, np.int32)
    lengths = np.diff(offsets)
    long = lengths >= width
    open_[offsets[:-1][long]] += 1
    np.subtract.at(open_, ends[long] - width + 1, 1)
    least[np.cumsum(open_)[:len(least)] <= 0] = 0
    padded = np.zeros(len(h) + span - 1, np.uint64)
    padded[span - 1:span - 1 + len(least)] = least
    at = np.flatnonzero(_rolled(padded, span, np.maximum)[:len(h)] == h)
    return at, h[at]


class _Block:
    """The documents of a block in one order, with their anchors."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        self.ids, self.width = ids, width
        self.order = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.offsets, self.data = text_bytes(table.column("text").combine_chunks())
        at, hashes = [], []
        for start, end in chunks(self.offsets, 1 << 18):
            o = self.offsets[start:end + 1]
            found, h = _anchor_hashes(self.data[o[0]:o[-1]], o - o[0], width)
            at.append(found + o[0])
            hashes.append(h)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.row = np.searchsorted(self.offsets, self.at, side="right") - 1
        # Anchors have small hashes; mixed once more they spread evenly over buckets.
        self.short, inverse = np.unique(mix64(self.hash) >> np.uint64(16), return_inverse=True)
        self.which = inverse
        # Whether two documents of this very block have the anchor.
        low = np.full(len(self.short), LAST)
        high = np.full(len(self.short), -1)
        np.minimum.at(low, inverse, self.row)
        np.maximum.at(high, inverse, self.row)
        self.shared = low < high

    def cuts(self, buckets: int) -> np.ndarray:
        """Places in ``short`` where equal ranges of hashes begin, and its end."""
        i = np.arange(buckets, dtype=np.uint64)
        each, rest = (np.uint64(x) for x in divmod(1 << 48, buckets))
        edges = i * each + (i * rest + np.uint64(buckets - 1)) // np.uint64(buckets)
        return np.append(np.searchsorted(self.short, edges), len(self.short))

    def suffixes(self, masks: dict[int, bytes], buckets: int):
        """Distinct suffixes with the bytes around them, and the occurrences of each."""
        cuts = self.cuts(buckets)
        keep = self.shared.copy()
        for bucket, mask in masks.items():
            a, b = cuts[bucket], cuts[bucket + 1]
            keep[a:b] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        live = np.flatnonzero(keep[self.which])
        at, row = self.at[live], self.row[live]
        reach = self.width - ANCHOR
        left = np.minimum(at - self.offsets[row], reach).astype(np.uint8)
        right = np.minimum(self.offsets[row + 1] - at - ANCHOR, reach).astype(np.uint8)
        padded = np.concatenate([np.zeros(reach, np.uint8), self.data, np.zeros(reach + ANCHOR, np.uint8)])
        total = ANCHOR + 2 * reach
        around = np.lib.stride_tricks.sliding_window_view(padded, total)[at]
        place = np.arange(total)
        around[(place < reach - left[:, None]) | (place >= reach + ANCHOR + right[:, None])] = 0
        full = np.zeros((len(at), -(-(total + 2) // 8) * 8), np.uint8)
        full[:, :total], full[:, total], full[:, total + 1] = around, left, right
        symbols = full.view(np.uint64)
        key = np.zeros(len(at), np.uint64)
        for i in range(symbols.shape[1]):
            key = mix64(key + symbols[:, i] + np.uint64(GOLDEN))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        if not (full[first[of]] == full).all():  # two suffixes with one hash
            _, first, of = np.unique(full, axis=0, return_index=True, return_inverse=True)
            of = of.reshape(-1)
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of, first = place[of], first[order]
        low = np.full(len(first), LAST)
        np.minimum.at(low, of, self.order[row])
        return at, row, of, full[first, :total + 2], low, self.hash[live][first]


def _packed(values: np.ndarray) -> bytes:
    """Bytes of the values by significance, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(payload: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _bucket_of(full: np.ndarray, hashes: np.ndarray, splitters: np.ndarray, finer: int, reach: int) -> np.ndarray:
    """Range of the suffix by its leading bytes; finer ones by the hash of its anchor."""
    lead = np.ascontiguousarray(full[:, reach:reach + 16]).view(">u8").astype(np.uint64)
    # Two symbols are compared one after the other.
    first = np.searchsorted(splitters[:, 0], lead[:, 0], side="left")
    last = np.searchsorted(splitters[:, 0], lead[:, 0], side="right")
    found = first.copy()
    for i in np.flatnonzero(first < last):
        found[i] += np.searchsorted(splitters[first[i]:last[i], 1], lead[i, 1], side="right")
    return found * finer + (mix64(hashes) % np.uint64(finer)).astype(np.int64)


def multikey_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each sorted row): rows sorted symbol by symbol, ties refined only."""
    order = np.argsort(symbols[:, 0], kind="stable")
    column = symbols[order, 0]
    fresh = np.ones(len(order), bool)
    fresh[1:] = column[1:] != column[:-1]
    for i in range(1, symbols.shape[1]):
        group = np.cumsum(fresh)
        tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((symbols[rows, i], group[tied]))
        order[tied] = rows[again]
        column, owner = symbols[order[tied], i], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (column[1:] != column[:-1]) | (owner[1:] != owner[:-1])
        fresh[tied] = new
    return order, np.cumsum(fresh) - 1


def _mark_owners(out: np.ndarray, full: np.ndarray, rank: np.ndarray, rows: np.ndarray, group: np.ndarray) -> None:
    """Fill ``out[rows]`` with the least rank of each string; ``group`` tells anchors apart."""
    reach = out.shape[1] - 1
    # Column by column in memory, as the rows of a tile lie far apart.
    near, own = np.ascontiguousarray(full[rows].T), rank[rows]
    found = out[rows]
    left, right = near[-2].astype(np.int64), near[-1].astype(np.int64)
    sides = []
    for have, step in ((left, -1), (right, 1)):
        ids = [(group - group[0]).astype(np.int32)]
        for n in range(1, reach + 1):
            byte = near[reach - n if step < 0 else reach + ANCHOR + n - 1].astype(np.int64)
            # Rows that end here are told apart from a byte of value 0.
            _, dense = np.unique(ids[-1] * np.int64(512) + np.where(have >= n, byte, 256), return_inverse=True)
            ids.append(dense.astype(np.int32))
        sides.append(ids)
    for o in range(reach + 1):
        ok = np.flatnonzero((left >= o) & (right >= reach - o))
        if not len(ok):
            continue
        _, same = np.unique(sides[0][o][ok] * np.int64(len(rows)) + sides[1][reach - o][ok], return_inverse=True)
        low = np.full(same.max() + 1, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(low, same, own[ok])
        found[ok, o] = low[same]
    out[rows] = found


def least_owner(full: np.ndarray, rank: np.ndarray, none: int, width: int, compared: int = COMPARED) -> np.ndarray:
    """(rows, reach + 1): least rank of the documents with the string that starts ``o`` bytes before each anchor.

    ``none`` where the row has no such string. Anchors are taken together up to ``compared`` rows.
    """
    reach = width - ANCHOR
    back = np.arange(reach + 1)
    there = (full[:, -2, None] >= back) & (full[:, -1, None] >= reach - back)
    out = np.where(there, rank[:, None].astype(np.int32), np.int32(none))
    symbols = np.ascontiguousarray(full[:, reach:reach + ANCHOR]).view(">u8").astype(np.uint64)
    order, group = multikey_order(symbols)
    many = np.bincount(group)[group] > 1
    rows, group = order[many], group[many]
    if not len(rows):
        return out
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(rows)]])
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + compared, side="right")) - 1)
        tile = slice(edges[at], edges[end])
        _mark_owners(out, full, rank, rows[tile], group[tile])
        at = end
    return out


def _senders(width: int, buckets: int, splitters: np.ndarray, finer: int):
    reach = width - ANCHOR

    def send_hashes(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        own = _Block(table, width)
        cuts = own.cuts(buckets)
        parts = [(int(b), own.short[cuts[b]:cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts))]
        deltas = [np.diff(x, prepend=np.uint64(0)) for _, x in parts]
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()),
                         "block": pa.array([block] * len(parts), pa.int64()),
                         "payload": pa.array([_packed(d) for d in deltas], pa.binary())})

    def match_hashes(table: pa.Table) -> pa.Table:
        sent = table.column("payload")
        every = np.concatenate([np.cumsum(_unpacked(p.as_py(), np.uint64)) for p in sent])
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        masks = []
        # Unpacked again one by one, so that a bucket's hashes are held once.
        for own in (np.cumsum(_unpacked(p.as_py(), np.uint64)) for p in sent):
            at = np.searchsorted(twice, own)
            masks.append(np.packbits(twice[np.minimum(at, len(twice) - 1)] == own).tobytes() if len(twice)
                         else bytes(-(-len(own) // 8)))
        return pa.table({"block": table.column("block"), "kind": pa.array([0] * len(sent), pa.int32()),
                         "bucket": table.column("bucket"), "payload": pa.array(masks, pa.binary())})

    def masks_of(table: pa.Table) -> dict[int, bytes]:
        return {b.as_py(): p.as_py() for k, b, p in zip(
            table.column("kind"), table.column("bucket"), table.column("payload")) if k.as_py() == 0}

    def send_suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "suffixes": [], "docs": []}
        if table.num_rows:
            own = _Block(table, width)
            *_, full, low, hashes = own.suffixes(masks_of(answers), buckets)
            goal = _bucket_of(full, hashes, splitters, finer, reach)
            order = np.argsort(goal, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(goal[order])) + 1):
                if len(part):
                    out["bucket"].append(int(goal[part[0]]))
                    out["block"].append(table.column("block")[0].as_py())
                    out["suffixes"].append(zstandard.ZstdCompressor(level=1).compress(full[part].tobytes()))
                    out["docs"].append(_packed(low[part]))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "block": pa.array(out["block"], pa.int64()),
                         "suffixes": pa.array(out["suffixes"], pa.binary()), "docs": pa.array(out["docs"], pa.binary())})

    def match_suffixes(table: pa.Table) -> pa.Table:
        full = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8).reshape(-1, ANCHOR + 2 * reach + 2)
                for x in table.column("suffixes")]
        ends = np.cumsum([0] + [len(x) for x in full])
        full = np.concatenate(full)
        docs, rank = np.unique(np.concatenate([_unpacked(x.as_py(), np.int64) for x in table.column("docs")]), return_inverse=True)
        low = least_owner(full, rank, len(docs), width)
        docs = np.append(docs, LAST)
        answers = [zstandard.ZstdCompressor(level=1).compress(docs[low[a:b]].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(answers), pa.int32()),
                         "bucket": table.column("bucket"), "payload": pa.array(answers, pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(table, width)
        at, row, of, full, _, hashes = own.suffixes(masks_of(answers), buckets)
        covered = np.zeros(len(own.data) + 1, np.int32)
        if len(full):
            low = np.full((len(full), reach + 1), LAST)
            goal = _bucket_of(full, hashes, splitters, finer, reach)
            order = np.argsort(goal, kind="stable")
            goal = goal[order]
            for k, b, p in zip(answers.column("kind"), answers.column("bucket"), answers.column("payload")):
                if k.as_py() == 1:
                    low[order[slice(*np.searchsorted(goal, [b.as_py(), b.as_py() + 1]))]] = np.frombuffer(
                        zstandard.ZstdDecompressor().decompress(p.as_py()), np.int64).reshape(-1, reach + 1)
            for o in range(reach + 1):
                start = at[low[of, o] < own.order[row]] - o
                np.add.at(covered, start, 1)
                np.subtract.at(covered, start + width, 1)
        gone = np.cumsum(covered[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = own.offsets[:-1][own.offsets[:-1] < len(gone)]
        edge[inner] = gone[inner]
        removed = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])[own.offsets]
        spans = np.concatenate([np.zeros(1, np.int64), np.cumsum(edge)])[own.offsets]
        kept = []
        for a, b in zip(own.offsets[:-1], own.offsets[1:]):
            kept.append(own.data[a:b][~gone[a:b]].tobytes())
        return pa.table({
            "doc_id": own.ids, "n_bytes": pa.array(np.diff(own.offsets), pa.int64()),
            "n_removed": pa.array(np.diff(removed), pa.int64()), "n_spans": pa.array(np.diff(spans), pa.int64()),
            "kept": pa.array(kept, pa.binary())})

    def cut_digest(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()),
                             "kept_sha256": pa.array([], pa.string())})
        out = cut(table, answers)
        digests = [hashlib.sha256(x.as_py()).hexdigest() for x in out.column("kept")]
        return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array(digests, pa.string()))

    return send_hashes, match_hashes, send_suffixes, match_suffixes, cut, cut_digest


def _leading(width: int, each: int):
    reach_end = 16

    def leading(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = data[a:b]
                at, _ = _anchor_hashes(text, np.array([0, len(text)]), width)
                for i in at[::max(1, len(at) // each)][:each]:
                    out.append(text[i:i + reach_end].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["lead"])
    return leading


def _splitters(docs: DataFrame, rows: int, ranges: int, width: int) -> np.ndarray:
    """Leading bytes that cut the sampled suffixes into ranges, as two symbols each."""
    if ranges < 2 or not rows:
        return np.zeros((0, 2), np.uint64)
    sample = docs.select("text").sample(False, min(1.0, SAMPLED_DOCS / rows), 1)
    found = sorted(r[0] for r in sample.mapInArrow(_leading(width, SAMPLED_EACH), "lead binary").collect())
    chosen = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    return np.frombuffer(b"".join(bytes(x) for x in chosen), ">u8").astype(np.uint64).reshape(-1, 2)


def cut_repetitions(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
                    texts: bool = False, bucket_blocks: int = BUCKET_BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte of the UTF-8 text is removed if a string of ``width`` bytes covers it that also
    starts in a document with a smaller doc_id. Strings are those of the input, so a copy of
    a copy goes too. With ``texts`` the remaining bytes are returned as ``kept`` instead of their digest.

    Null and empty texts have no bytes; texts of fewer than ``width`` bytes keep all. A null
    doc_id counts as larger than any other, and rows of one doc_id (or of none) take nothing from each
    other. Empty tables give no rows; other columns are not read. ``width`` is at least 33.

    A block is ``block_bytes`` of text, a bucket the hashes of ``bucket_blocks`` blocks or the suffixes of half as many. All different surroundings
    of one anchor meet in one task, so a string that a very large number of texts continue in different ways makes that task long.
    A very long text is in one block, with arrays of some 50 times its bytes.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    count = max(1, -(-int(size or 0) // block_bytes))
    buckets = -(-count // bucket_blocks)
    sorted_in = min(count, 2 * buckets)
    ranges = min(sorted_in, SPLITTERS)
    splitters = _splitters(docs, rows, ranges, width)
    finer = -(-sorted_in // ranges)
    send_hashes, match_hashes, send_suffixes, match_suffixes, cut, cut_digest = _senders(width, buckets, splitters, finer)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    answer = "block bigint, kind int, bucket bigint, payload binary"
    masks = (blocks.groupBy("block").applyInArrow(send_hashes, "bucket bigint, block bigint, payload binary")
             .groupBy("bucket").applyInArrow(match_hashes, answer))
    owners = (blocks.groupBy("block").cogroup(masks.groupBy("block"))
              .applyInArrow(send_suffixes, "bucket bigint, block bigint, suffixes binary, docs binary")
              .groupBy("bucket").applyInArrow(match_suffixes, answer))
    last = "kept binary" if texts else "kept_sha256 string"
    return (blocks.groupBy("block").cogroup(masks.union(owners).groupBy("block"))
            .applyInArrow(cut if texts else cut_digest,
                          f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}"))
