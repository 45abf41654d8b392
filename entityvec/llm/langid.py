"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityvec.llm.arrays import GOLDEN, chunks, mix64, text_bytes

UNKNOWN = "und"
#: Cells of the hashed counts, as a power of two, and the n-grams that are counted.
BITS, GRAMS = 16, (1, 2, 3)
#: Most rows that are learned from, those with the least hash of their doc_id.
LEARNED_ROWS = 20_000
#: Most languages of one model; a model has 2 ** BITS numbers for each.
LANGUAGES = 1024
SMOOTHING = 0.5
#: Texts looked at together, which bounds the numbers held for each language.
TEXTS = 1 << 12
_LETTER = regex.compile(r"\p{L}")


def _cells(texts: list[str], bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of each n-gram of the lower-cased texts, all sizes in one table."""
    lower = [" ".join(t.lower().split()) for t in texts]
    lengths = np.array([len(t) for t in lower])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lower)), lengths)
    owners, cells = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(grams) + 1):
        if len(points) < n:
            break
        value = value[:len(points) - n + 1] * np.uint64(0xD1342543DE82EF95) + points[n - 1:]
        if n in grams:
            inside = owner[n - 1:] == owner[:len(points) - n + 1]
            hashed = (value + np.uint64(n)) * np.uint64(GOLDEN)
            cells.append((hashed >> np.uint64(64 - bits))[inside].astype(np.int64))
            owners.append(owner[n - 1:][inside])
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(cells)


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of parts of the batch that fit in memory as arrays; null is empty."""
    offsets, _ = text_bytes(batch.column(column))
    for start, end in chunks(offsets, 1 << 18, TEXTS):
        yield start, [t or "" for t in batch.column(column).slice(start, end - start).to_pylist()]


def _counter(bits: int, grams: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in _groups(batch, 0):
                owner, cell = _cells(texts, bits, grams)
                here = np.array(langs[start:start + len(texts)], object)
                for lang in set(here.tolist()):
                    mine = (here == lang)
                    rows[lang] = rows.get(lang, 0) + int(mine.sum())
                    tables.setdefault(lang, np.zeros(1 << bits, np.int64))
                    tables[lang] += np.bincount(cell[mine[owner]], minlength=1 << bits)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()),
                 pa.array(np.append(table[at], rows[lang]), pa.int64())], names=["lang", "cell", "n"])
    return count


class Model:
    """Log probabilities of each cell in each language."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray, bits: int, grams: tuple[int, ...]):
        self.langs, self.weights, self.prior, self.bits, self.grams = langs, weights, prior, bits, grams

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; UNKNOWN with 0 where none is to be had."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        owner, cell = _cells(texts, self.bits, self.grams)
        total = np.vstack([np.bincount(owner, self.weights[i][cell], len(texts)) for i in range(len(self.langs))]).astype(np.float64)
        total += self.prior[:, None]
        best = total.argmax(axis=0)
        score = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
        real = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        return [self.langs[b] if r else UNKNOWN for b, r in zip(best, real)], np.where(real, score, 0.0)


def train(labelled: DataFrame, rows: int = LEARNED_ROWS, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> Model:
    """Model of ``labelled`` (doc_id, text, lang), from at most ``rows`` of its rows.

    Rows without lang are left out, null texts count as empty; without rows the model knows no language.
    Whole texts are counted. The rows with the least hash of doc_id are taken, so a
    re-run learns the same.
    """
    chosen = (labelled.filter("lang is not null")
              .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                      F.xxhash64("doc_id").alias("h")))
    # The hash under which about ``rows`` lie is found on numbers alone, then texts are read once.
    n = chosen.count()
    if n > rows:
        cut = chosen.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        chosen = chosen.filter(F.col("h") <= cut)
    counted = (chosen.select("text", "lang").mapInArrow(_counter(bits, grams), "lang string, cell int, n bigint")
               .groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in chosen.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = {x: i for i, x in enumerate(langs)}
    # At most 2 ** bits numbers for each language.
    counts, docs = np.zeros((len(langs), 1 << bits)), np.zeros(len(langs))
    got = counted.toPandas()
    row = got["lang"].map(place).to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    cell, n = got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    counts[row[cell >= 0], cell[cell >= 0]] = n[cell >= 0]
    docs[row[cell < 0]] = n[cell < 0]
    weights = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(axis=1, keepdims=True))
    return Model(langs, weights, np.log(docs) - np.log(docs.sum()) if langs else docs, bits, grams)


def _predictor(sent, text: int, kept: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in _groups(batch, text):
                lang, score = sent.value.predict(texts)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(langs, pa.string()),
                 pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*batch.schema.names[:kept], "_lang", "_score"])
    return predict


def identify(docs: DataFrame, model: Model, keep: list[str], label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the language and its score, from column text alone.

    A null text and one without any letter are UNKNOWN with score 0; so is everything if the model
    knows no language. Rows are independent of each other.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    if "text" in keep and dict(docs.dtypes)["text"] == "string":
        text = keep.index("text")
    else:
        text = len(keep)
        columns.append(F.col("text").cast("string").alias("_text"))
    source = docs.select(*columns)
    schema = source.select(*[f"_{i}" for i in range(len(keep))]).schema.add("_lang", "string").add("_score", "double")
    out = source.mapInArrow(_predictor(sent, text, len(keep)), schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)],
                      F.col("_lang").alias(label), F.col("_score").alias(score))


def held_out() -> Column:
    """Rows that are never learned from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def languages(docs: DataFrame, rows: int = LEARNED_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    The model learns from rows whose crc32 of doc_id leaves another remainder than 2 by 4; the prediction sees the text only.
    A null, empty or blank text and one without any letter give ``und`` with score 0, and so does every text if no row
    to learn from has a lang. A null doc_id is held out. Texts of any length are read whole, one text's n-grams at a time being
    in memory (some 50 times its bytes). Of equally likely languages the first by name is given. Repeated rows are
    predicted alike, each is learned from. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()), rows)
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
