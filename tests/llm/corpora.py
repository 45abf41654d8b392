"""Small tables with every awkward case, for the corpus operators' tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, **columns):
    """Documents of ``texts`` (a list, or (doc_id, text) pairs)."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t or "")) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(words))


def edges(spark):
    """Null in each column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long, plain = prose(1, 30_000), prose(2, 60)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, long, "en", "b", len(long)),
            (5, long.upper(), "fr", None, len(long)), (6, plain, "en", "a", 60), (6, plain, "en", "a", 60),
            (7, plain, "en", "a", 60), (None, plain, "en", "a", 60), (None, "word", None, "b", 4), (8, "é" * 200, "fr", "b", 200),
            (9, "x" * 70_000, "en", "b", 70_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    # Names that operators use inside.
    for name in ("size", "row", "key", "band", "kept", "score", "block", "n", "a", "b", "digest", "text_key", "component", "_metadata"):
        frame = frame.withColumn(name, frame.n_chars)
    return frame


def empty(spark):
    return edges(spark).limit(0)
