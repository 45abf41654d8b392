"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a binary vector with an element for each (letter, how many-th occurrence).
One inserted, deleted or replaced letter changes at most two elements. The elements are dealt over
``PARTS`` parts; two words that differ in at most two elements agree on all but two parts, so
the letters in every choice of ``PARTS - 2`` parts are the signatures of a word, and equal ones are joined. An edit
also leaves the first or the last half of a word as it is, which goes into the signature; that
keeps words of the same letters in another order apart. Joined words are verified by their edit distance.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityvec.functions.scratch import written
from entityvec.llm.arrays import GOLDEN, mix64, text_bytes

#: A word has so many code points and occurrences at least; one in ``NOISE`` runs loses a letter.
SHORTEST, LEAST, NOISE = 5, 3, 97
PARTS, CHANGED = 4, 2
#: Different words that a task counts before it hands them on, and letters worked on together.
HELD, LETTERS = 200_000, 200_000


def _counter(shortest: int, noise: int):
    run = regex.compile(rf"[a-zA-ZÀ-ÿ]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # bytes.lower() changes A-Z only.
                found = Counter(run.findall(text.encode().lower().decode()))
                start = zlib.crc32(f"{'' if (d := doc.as_py()) is None else d}:".encode())
                for word, n in found.items():
                    drawn = zlib.crc32(word.encode(), start)
                    if drawn % noise == 0:
                        at = drawn % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    total[word] += n
                if len(total) >= HELD:
                    yield given()
                    total.clear()
        if total:
            yield given()
    return count


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """word, n of the words of ``docs`` (doc_id, text) with at least ``least`` occurrences."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return (rows.mapInArrow(_counter(shortest, noise), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def _hashed(values: np.ndarray, salt: int) -> np.ndarray:
    return mix64(values.astype(np.uint64) + np.uint64(salt * GOLDEN & 0xFFFFFFFFFFFFFFFF))


def signatures(words: list[str]) -> np.ndarray:
    """(words, signatures) keys; two words one edit apart have one in common at least.

    A pair's shorter word has ``c`` letters, so each word is once the shorter one or as long, once the longer
    one. Of ``c`` letters one edit leaves the first or the last ``c // 2`` unchanged.
    """
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    # Number of each letter among its equals in the word.
    order = np.lexsort((points, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (points[order][1:] != points[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    index = np.arange(len(order))
    nth = index - np.maximum.accumulate(np.where(fresh, index, 0))
    element = _hashed((points[order] << 32) | nth, 1)
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (owner[order], (element % np.uint64(PARTS)).astype(np.int64)), mix64(element))
    # Hashes of first and last halves from running sums over the words.
    place = index - first[owner]
    ends = np.append(0, np.cumsum(lengths))[:-1]
    keys = []
    for longer in (0, 1):
        shorter = np.maximum(lengths - longer, 0)
        half = shorter // 2
        back = lengths[owner] - 1 - place
        for side, spot in enumerate((place, back)):
            inside = spot < half[owner]
            value = np.where(inside, mix64(_hashed((points << 32) | spot, 2 + side)), np.uint64(0))
            total = np.append(np.zeros(1, np.uint64), np.cumsum(value))
            kept = total[ends + lengths] - total[ends]
            base = mix64(kept + _hashed(shorter * 2 + side, 4))
            for chosen in combinations(range(PARTS), PARTS - CHANGED):
                key = base
                for part in chosen:
                    key = mix64(key + sums[:, part] + np.uint64((part + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
                keys.append(key)
    return np.stack(keys, axis=1)


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, _ = text_bytes(batch.column(0))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + LETTERS, side="right")) - 1
            end = min(batch.num_rows, max(end, start + 1))
            some = batch.slice(start, end - start)
            keys = signatures(some.column(0).to_pylist())
            rows = pa.array(np.repeat(np.arange(end - start), keys.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), *(c.take(rows) for c in some.columns)], names=["key", "word", "n"])
            start = end


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b, of all ``words`` (word, n) that are exactly one edit apart."""
    signed = words.select("word", "n").mapInArrow(_signer, "key bigint, word string, n bigint")
    one, other = (signed.select("key", F.col("word").alias(w), F.col("n").alias(f"n_{w}")) for w in "ab")
    # A sort-merge join: a key that very many words share is split by adaptive execution.
    met = one.hint("merge").join(other, "key").filter("a < b")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms are followed at double speed until none goes on.

    A form has twice its word's occurrences at least, so there are no cycles and few rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(now.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if step.filter("_moved").isEmpty():
            return step.drop("_moved")
        now = step.drop("_moved")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; one run in ``noise``, drawn by its document and
    itself, loses one code point. Kept are words of at least ``shortest`` code points and ``least`` occurrences. Two are near
    if exactly one code point is inserted, deleted or replaced. ``form`` is the near word of most occurrences
    if these are twice the word's at least, equal ones by code points; ``root`` is where following forms ends.

    A null or empty text has no words, a null doc_id counts as empty in the draw, and a word of any length is compared
    whole. Ties of n go to the smaller word. Repeated rows count as often as they occur. An empty table gives no rows.
    Columns other than doc_id and text are not read, whatever their names.
    """
    words = written(word_counts(docs, shortest, least, noise), "words")
    pairs = written(near_words(words), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("chosen", -F.col("best.m") >= 2 * F.col("n")).select(
        "word", F.when(F.col("chosen"), F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("chosen"), -F.col("best.m")).alias("form_n"))
    judged = written(judged, "judged")
    roots = _roots(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
