"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of arrays."""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the byte-level pre-tokenizer splits text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers, and the longest of them, in characters.
KNOWN, KNOWN_LENGTH = 500_000, 64
#: Characters of text whose pre-tokens are merged together.
HELD = 1 << 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Merges:
    """Ranks of symbol pairs as sorted arrays, for lookups of many pairs at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        self.byte_id = np.array([vocabulary[symbols[b]] for b in range(256)], np.int64)
        self.base = np.int64(max(vocabulary.values()) + 1)
        keys = np.array([vocabulary[a] * int(self.base) + vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.none = len(keys)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank ``none`` where there is no merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.none), self.made[at]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty piece.

        All pieces are held as one ragged array of symbols. In each round every piece merges
        all places of its own lowest-ranked pair, from left to right; pieces without a
        mergeable pair are set aside.
        """
        lengths = np.array([len(p) for p in pieces])
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        out = np.zeros(len(pieces), np.int64)
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            rank, made = self.look_up(symbols[:-1], symbols[1:])
            rank = np.where(inside, rank, self.none)
            starts = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(np.append(rank, self.none), starts)
            mine = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            hit = (rank == mine[:-1]) & (rank < self.none)
            # In a run of overlapping pairs every second one merges, from the left.
            place = np.arange(len(hit))
            opens = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(opens, place, 0)) if len(hit) else place
            hit &= (place - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            done = mine == self.none
            np.add.at(out, owner[starts[lowest == self.none]], np.diff(np.append(starts, len(symbols)))[lowest == self.none])
            keep &= ~done
            symbols, owner = symbols[keep], owner[keep]
        return out


def load(path: str) -> tuple[Merges, list[str]]:
    """Merges and special strings of a tokenizer file of the byte-level BPE kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if (spec["model"]["type"], pre.get("type"), pre.get("add_prefix_space"), spec["normalizer"]) != (
            "BPE", "ByteLevel", False, None) or spec["model"].get("ignore_merges"):
        raise ValueError(f"{path}: only plain byte-level BPE without a prefix space is supported")
    special = []
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"{path}: special strings that take blanks or words with them are not supported")
        special.append(t["content"])
    return Merges(spec["model"]["vocab"], spec["model"]["merges"]), special


def _counter(merges_sent, special: list[str], limit: int):
    # Longer special strings first; each is one token wherever it stands.
    split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    pattern = regex.compile(PATTERN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_sent.value
        known: dict[str, int] = {}

        def learn(pieces: list[str]) -> None:
            for i in range(0, len(pieces), 65536):
                part = pieces[i:i + 65536]
                known.update(zip(part, merges.counts([p.encode("utf-8") for p in part]).tolist()))

        def total(held: list[tuple[int, list[str]]]) -> list[int]:
            unknown = {p for _, pieces in held for p in pieces if p not in known}
            learn(list(unknown))
            out = [n + sum(map(known.__getitem__, pieces)) for n, pieces in held]
            for p in unknown:
                if len(p) > KNOWN_LENGTH:
                    del known[p]
            if len(known) > KNOWN:
                known.clear()
            return out

        for batch in batches:
            sizes, totals, held, size = [], [], [], 0
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                parts = split.split(text) if split is not None else [text]
                held.append((len(parts) - 1, [p for part in parts for p in pattern.findall(part)]))
                size += len(text)
                if size >= HELD:
                    totals += total(held)
                    held, size = [], 0
            totals += total(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([t > limit for t in totals], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``path`` is a byte-level BPE tokenizer file that the driver can read; the counts are those of
    the tokenizers library without added tokens. A special string inside a text is one token.
    Null and empty texts have no bytes and no tokens. Rows are independent: nulls in
    doc_id and repeated rows pass through, an empty table gives no rows, and other columns are not read.
    """
    merges, special = load(path)
    # The vocabulary's size does not depend on the documents.
    sent = docs.sparkSession.sparkContext.broadcast(merges)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _counter(sent, special, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
