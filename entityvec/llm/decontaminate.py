"""Benchmark decontamination as a prefix-filtered join, in DataFrame operations only.

Tokens are short word shingles. A window of an item lies in a document only if its rarest
token does, so that one token is the window's whole necessary prefix: documents are joined
with it, the window's offset bounds where it can start and end, and the words in between
are compared exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityvec.functions.scratch import written

WINDOW, TOKEN = 13, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows up to which they are sent to every task: some 40 MB, and as many tokens in the counting pass.
SENT_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _token(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(window_id, words, n, item_id): each distinct window of each item."""
    w = F.col("w")
    starts = F.when(F.size(w) > window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(
        F.array(F.lit(0)))
    return (items.select("item_id", words_of(F.col("text").cast("string")).alias("w"))
            .filter(F.size("w") > 0)
            .select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, window))).alias("words"))
            .distinct()
            .select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window_id"), "words",
                    F.size("words").alias("n"), "item_id"))


def _positions(docs: DataFrame, size: int) -> DataFrame:
    """Every token of every text, at its word position."""
    return (docs.select("doc_id", "text_key", words_of(F.col("text")).alias("w"))
            .select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "word"))
            .filter(F.col("pos") <= F.size("w") - size)
            .select("doc_id", "text_key", "w", "pos", _token(F.col("w"), F.col("pos"), size).alias("token")))


def _maybe_sent(df: DataFrame, sent: bool) -> DataFrame:
    return F.broadcast(df) if sent else df


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, token: int = TOKEN,
                 hit_share: int = 20, sent_rows: int = SENT_ROWS, text_key: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text. A window is ``window``
    consecutive words of an item, or all words of an item that has fewer. A document word is
    hit if an occurrence of a window covers it; the document is contaminated if any word is
    hit and ``hit_share`` * n_hit >= n_words.

    A null or wordless text has no words and no hits; an item without words has no windows.
    An item without item_id hits words but is not counted or listed; repeated items count
    once. Rows with equal doc_id (null included) and equal text get equal results. With no
    items every document is clean, and no documents give no rows. Other columns are not read.

    With ``text_key`` the rows carry xxhash64(text) too, to tell apart texts of one doc_id.

    Up to ``sent_rows`` windows are sent to every task and texts never move; beyond that
    tokens are shuffled with the words around them.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    listed = written(item_windows(items, window), "windows")
    by_window = listed.select("window_id", "words", "n").distinct()
    tokens = by_window.select(
        "window_id", "words", "n", F.least("n", F.lit(token)).alias("size")).select(
        "*", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: i)).alias("p", "at"))
    sizes = [r[0] for r in by_window.select(F.least("n", F.lit(token)).alias("size")).distinct().collect()]
    sent = listed.limit(sent_rows + 1).count() <= sent_rows
    found = None
    for size in sorted(sizes):
        own = tokens.filter(F.col("size") == size).select(
            "window_id", "words", "n", "at", _token(F.col("words"), F.col("at"), size).alias("token"))
        counts = (_positions(docs, size).select("token")
                  .join(_maybe_sent(own.select("token").distinct(), sent), "token")
                  .groupBy("token").agg(F.count(F.lit(1)).alias("seen")))
        counts = written(counts, "token-counts")
        # A window with a token that no document has cannot occur.
        prefix = (own.join(counts, "token", "left")
                  .groupBy("window_id").agg(F.min_by(
                      F.struct("token", "at", "words", "n"),
                      F.struct(F.coalesce("seen", F.lit(0)), "token", "at")).alias("rarest"),
                      F.min(F.coalesce("seen", F.lit(0))).alias("seen"))
                  .filter("seen > 0").select("window_id", "rarest.*"))
        positions = _positions(docs, size)
        if sent:
            low = F.lit(0)
        else:
            low = F.greatest(F.lit(0), F.col("pos") - window)
            positions = positions.withColumn("low", low).withColumn(
                "w", F.slice("w", F.col("low") + 1, 2 * window + size))
            low = F.col("low")
        start = F.col("pos") - F.col("at")
        hits = (positions.join(_maybe_sent(prefix, sent), "token")
                .filter((start >= 0) & (start - low + F.col("n") <= F.size("w")))
                .filter(F.slice("w", start - low + 1, F.col("n")) == F.col("words"))
                .select("doc_id", "text_key", "window_id", start.alias("start"), (start + F.col("n")).alias("stop")))
        found = hits if found is None else found.union(hits)
    base = docs.select("doc_id", "text_key", F.size(words_of(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_words"))
    if found is None:
        per_doc = base.select("doc_id", "text_key", F.lit(0).cast("bigint").alias("n_hit"),
                              F.array().cast("array<string>").alias("ids")).limit(0)
    else:
        per_doc = _per_document(written(found, "hits"), listed, sent)
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("d.text_key").eqNullSafe(F.col("h.text_key"))
    n_hit = F.coalesce("h.n_hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("h.ids", F.array().cast("array<string>"))
    return base.alias("d").join(per_doc.alias("h"), same, "left").select(
        "d.doc_id", *(["d.text_key"] if text_key else []), "d.n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (hit_share * n_hit >= F.col("d.n_words"))).alias("contaminated"))


def _per_document(hits: DataFrame, listed: DataFrame, sent: bool) -> DataFrame:
    """Hit words and item ids of each document; equal rows of hits count once."""
    row = ["doc_id", "text_key"]
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["stop"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("hit")),
        lambda acc: acc["hit"])
    n_hit = hits.groupBy(row).agg(covered.alias("n_hit"))
    ids = (hits.select(*row, "window_id").distinct()
           .join(_maybe_sent(listed.select("window_id", F.col("item_id").cast("string").alias("item")), sent), "window_id")
           .groupBy(row).agg(F.array_sort(F.collect_set("item")).alias("ids")))
    both = (n_hit.withColumn("ids", F.lit(None).cast("array<string>"))
            .unionByName(ids.withColumn("n_hit", F.lit(None).cast("bigint"))))
    return both.groupBy(row).agg(F.max("n_hit").alias("n_hit"), F.first("ids", ignorenulls=True).alias("ids"))
