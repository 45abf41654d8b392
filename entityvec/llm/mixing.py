"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityvec.functions.hashing import keyed_hash
from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import written

WEIGHTS = (5, 2, 1)
#: Cells that the ranking variable's range is cut into, at each of two levels.
CELLS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks; null has none."""
    parts = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("bigint")


def _ordered(sources: DataFrame) -> DataFrame:
    """``sources`` with 0-based ``place`` by code point, null last, in many tasks."""
    parts = written(sources.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("part", F.spark_partition_id()), "sources")
    # One row for each partition that holds sources, not for each source.
    before = (parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (parts.join(before, "part")
            .withColumn("place", F.row_number().over(inside) - 1 + F.col("before")).drop("part", "before"))


def targets(sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``target`` words.

    ``percent`` of all words is shared by weight; no target exceeds ``most`` times its
    source, and what is cut off goes to the others by weight until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    full = written(_ordered(sources).withColumn("weight", weight), "weights")
    cap = F.lit(100 * most).cast("decimal(38,0)") * F.col("source_size")
    total = full.agg(F.sum("source_size")).first()[0] or 0
    budget, rest, shares, level = percent * total, percent * total, 1, None
    while True:
        # The level only rises, so a source once at its cap stays there.
        capped = F.lit(False) if level is None else (
            F.col("weight") * F.lit(level[0]).cast("decimal(38,0)") > cap * F.lit(level[1]))
        row = full.agg(F.sum(F.when(capped, cap)).alias("c"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        rest, shares = budget - int(row["c"] or 0), int(row["w"] or 0)
        if not shares or (rest, shares) == level:
            break
        level = (rest, shares)
    shared = F.col("weight") * F.lit(float(rest)) / F.lit(100.0 * max(shares, 1))
    return full.withColumn("target", F.when(capped, F.lit(float(most)) * F.col("source_size")).otherwise(shared))


def _crossing(sums: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """First cell of each source whose running sum exceeds what is still wanted."""
    running = Window.partitionBy("place").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    return (sums.withColumn("upto", F.sum("words").over(running) + F.col("done"))
            .filter(F.col("upto") > F.col("wanted"))
            .groupBy("place").agg(F.min_by(F.struct(cell, (F.col("upto") - F.col("words")).alias("done")), cell).alias("c"))
            .select("place", *[f"c.{k}" for k in keys]))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150,
               most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    ``docs`` has doc_id, text and source; size is the number of words of the text. Sources
    are ordered by code point, a null source last as a source of its own, and take
    ``weights`` in turn. target / source_size is the number of copies expected of each
    document: its whole part is taken for certain, its fraction is the inclusion
    probability p of one more copy. Documents are ranked by (U / (1 - U)) / (p / (1 - p)) with
    U drawn from ``seed`` and doc_id, and taken in that order while their words fit; then the
    one document that fits the remaining gap best is added, if that brings the source nearer.
    taken is size times the number of copies.

    Null and blank texts have size 0 and take 0. Null doc_ids share one draw, as do
    repeated rows; ties are broken by doc_id and then by row. An empty table gives an empty
    result. Other columns are not read.

    Only narrow rows without texts are written; sources above a few million words are cut
    into cells of the ranking variable, so no task sorts a source whole.
    """
    sized = written(docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0))).otherwise(F.lit(0.0))
    plan = (targets(sources, weights, percent, most)
            .withColumn("whole", F.least(F.floor(copies), F.lit(most)).cast("bigint"))
            .withColumn("p", copies - F.col("whole"))
            .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    plan = written(plan, "mix-plan")
    u = (F.conv(F.substring(keyed_hash(seed, "doc_id"), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = F.col("p") / F.nullif(1 - F.col("p"), F.lit(0.0))
    ratio = (F.col("u") / (1 - F.col("u"))) / F.nullif(odds, F.lit(0.0))
    ranked = (sized.alias("d").join(sent_if_small(plan).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
              .select("doc_id", "size", "row", "place", "source_size", "target", "whole", "p", "wanted", u.alias("u"))
              .withColumn("v", F.coalesce(ratio / (1 + ratio), F.col("u")))
              .withColumn("c1", F.floor(F.col("v") * CELLS))
              .withColumn("c2", F.floor(F.col("v") * (CELLS * CELLS)))
              .drop("u", "p"))
    key = F.struct("v", "doc_id", "row")

    first = _crossing(ranked.groupBy("place", "c1").agg(
        F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.lit(0).alias("done")), "c1", ["c1", "done"])
    first = written(first, "mix-cells")
    inside = ranked.join(sent_if_small(first), ["place", "c1"])
    second = _crossing(inside.groupBy("place", "c2").agg(
        F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("done").alias("done")), "c2", ["c2", "done"])
    second = written(second, "mix-cells")
    order = Window.partitionBy("place").orderBy("v", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = (ranked.join(sent_if_small(second), ["place", "c2"])
            .withColumn("upto", F.sum("size").over(order) + F.col("done"))
            .withColumn("fits", F.col("upto") <= F.col("wanted"))
            .groupBy("place").agg(F.max("c2").alias("edge"), F.max(F.when(F.col("fits"), key)).alias("bound"),
                                  F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.max("done")).alias("sum")))
    last = written(last, "mix-bounds")
    gap = F.col("wanted") - F.col("sum")
    marked = (ranked.join(sent_if_small(last), "place", "left")
              .withColumn("key", key)
              .withColumn("in", F.coalesce((F.col("c2") < F.col("edge")) | (
                  (F.col("c2") == F.col("edge")) & F.coalesce(F.col("key") <= F.col("bound"), F.lit(False))), F.lit(True))))
    off = F.abs(F.col("size") - gap)
    extra = (marked.filter(~F.col("in") & (off < gap))
             .groupBy("place").agg(F.min_by("row", F.struct(off, "key")).alias("extra")))
    extra = written(extra, "mix-extra")
    taken = F.col("whole") + (F.col("in") | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))).cast("bigint")
    return marked.join(sent_if_small(extra), "place", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * taken).alias("taken"))
