"""Exact ranks, cuts and percentiles without sorting everything in one task.

A key's place in the order is its keyed hash (ties by the key itself). Hash prefixes are
counted first (at most ``16**digits`` counters reach the driver), so a cut needs a sort of
one prefix only and a full ranking needs a sort within prefixes only.
"""

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.hashing import keyed_hash
from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import written

PREFIX_DIGITS = 3


@dataclass(frozen=True)
class Cut:
    """Smallest (hash, key) that is *not* before the cut; ``None`` hash = everything is."""

    digest: str | None
    key: Any = None
    key_type: T.DataType | None = None

    def covers(self, seed: int, key: Column) -> Column:
        if self.digest is None:
            return F.lit(True)
        # One comparison of pairs, so that the hash is computed once per row.
        return F.struct(keyed_hash(seed, key), key) < F.struct(
            F.lit(self.digest), F.lit(self.key).cast(self.key_type))


def hash_cuts(keys: DataFrame, key: str, seed: int,
              ranks: Callable[[int], Sequence[int]],
              digits: int = PREFIX_DIGITS) -> tuple[int, list[Cut]]:
    """Number of keys, and for each wanted count r the cut that has r keys before it.

    ``keys`` must hold each key once; ``ranks`` maps the number of keys to the counts.
    """
    prefix = F.substring(keyed_hash(seed, key), 1, digits)
    counts = sorted((r["p"], r["n"]) for r in
                    keys.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends, total = [], 0
    for _, n in counts:
        total += n
        ends.append(total)
    wanted = list(ranks(total))
    place: dict[int, tuple[str, int]] = {}
    for r in wanted:
        if 0 <= r < total:
            b = bisect_right(ends, r)
            place[r] = (counts[b][0], r - (ends[b - 1] if b else 0))
    found: dict[tuple[str, int], Cut] = {}
    if place:
        within = Window.partitionBy("p").orderBy("h", key)
        hit = F.lit(False)
        for p, offset in set(place.values()):
            hit = hit | ((F.col("p") == p) & (F.col("rn") == offset + 1))
        rows = (keys.select(key, keyed_hash(seed, key).alias("h"), prefix.alias("p"))
                .filter(F.col("p").isin(sorted({p for p, _ in place.values()})))
                .withColumn("rn", F.row_number().over(within)).filter(hit).collect())
        found = {(r["p"], r["rn"] - 1): Cut(r["h"], r[key], keys.schema[key].dataType)
                 for r in rows}
    return total, [found[place[r]] if r in place else Cut(None) for r in wanted]


def take_by_hash(df: DataFrame, key: str, seed: int,
                 size: Callable[[int], int]) -> tuple[DataFrame, int, int]:
    """Sample without replacement: the ``size(total)`` first keys in hash order.

    ``df`` must hold each key once. Returns the sample, its size and the total.
    """
    total, (cut,) = hash_cuts(df, key, seed, lambda n: [size(n)])
    return df.filter(cut.covers(seed, F.col(key))), min(size(total), total), total


def dense_rank_by_hash(df: DataFrame, key: str, seed: int, name: str = "rank",
                       digits: int = PREFIX_DIGITS) -> tuple[DataFrame, int]:
    """0-based position of each (unique) key in hash order, and the number of keys."""
    h = keyed_hash(seed, key)
    rows = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, digits))
    counts = sorted((r["_p"], r["n"]) for r in
                    rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    start, offsets = 0, []
    for p, n in counts:
        offsets.append((p, start))
        start += n
    # At most 16**digits rows, whatever the data.
    table = df.sparkSession.createDataFrame(offsets, "_p string, _start bigint")
    within = Window.partitionBy("_p").orderBy("_h", key)
    ranked = (rows.join(F.broadcast(table), "_p")
              .withColumn(name, F.row_number().over(within) - 1 + F.col("_start"))
              .drop("_p", "_h", "_start"))
    return ranked, start


def rank_in_group(df: DataFrame, group: str, key: str, seed: int, name: str = "rank",
                  hot_rows: int = 1_000_000, digits: int = PREFIX_DIGITS) -> DataFrame:
    """0-based position of each key inside its group, in hash order.

    Groups above ``hot_rows`` rows are cut into hash prefixes with precounted offsets, so
    no task ever sorts such a group whole. They stay a table, however many there are.
    """
    rows = df.withColumn("_h", keyed_hash(seed, key))
    hot = written(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
                  .select(group, F.lit(True).alias("_hot")), "hot-groups")
    if hot.isEmpty():
        plain = Window.partitionBy(group).orderBy("_h", key)
        return rows.withColumn(name, F.row_number().over(plain) - 1).drop("_h")
    marks = sent_if_small(hot)
    rows = (rows.join(marks, group, "left")
            .withColumn("_p", F.when(F.col("_hot"), F.substring("_h", 1, digits)).otherwise("")))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = (rows.filter("_hot").groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_start", F.sum("_n").over(before) - F.col("_n")).drop("_n"))
    within = Window.partitionBy(group, "_p").orderBy("_h", key)
    return (rows.withColumn(name, F.row_number().over(within) - 1)
            .join(offsets, [group, "_p"], "left")
            .withColumn(name, F.col(name) + F.coalesce("_start", F.lit(0)))
            .drop("_h", "_p", "_hot", "_start"))


def exact_percentiles(df: DataFrame, value: str, percents: Sequence[float],
                      buckets: int = 256, small: int = 1_000_000) -> list[float]:
    """Linearly interpolated percentiles, exact at any size.

    Equal values are counted together, split points come from a bounded quantile sketch,
    and only the value ranges that hold a wanted rank are sorted, each in its own task.
    Up to ``small`` values the built-in aggregate is used.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        raise ValueError("no values to take percentiles of")
    if n <= small:
        row = values.agg(F.percentile("v", F.array(*[F.lit(p / 100.0) for p in percents]))).first()
        return [float(x) for x in row[0]]
    weighted = values.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    points = sorted(set(values.approxQuantile(
        "v", [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets))))
    weighted = weighted.withColumn("b", _bucket_of(F.col("v"), points))
    counts = sorted((r["b"], r["n"]) for r in
                    weighted.groupBy("b").agg(F.sum("w").alias("n")).collect())
    ends, total = [], 0
    for _, c in counts:
        total += c
        ends.append(total)
    places = [p / 100.0 * (total - 1) for p in percents]
    wanted = sorted({r for h in places for r in (math.floor(h), math.ceil(h))})
    starts = {counts[i][0]: (ends[i - 1] if i else 0) for i in range(len(counts))}
    by_bucket: dict[int, list[int]] = {}
    for r in wanted:
        by_bucket.setdefault(counts[bisect_right(ends, r)][0], []).append(r)
    within = Window.partitionBy("b").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hit = F.lit(False)
    for b, ranks in by_bucket.items():
        for r in ranks:
            o = r - starts[b]
            hit = hit | ((F.col("b") == b) & (F.col("upto") > o)
                         & (F.col("upto") - F.col("w") <= o))
    rows = (weighted.filter(F.col("b").isin(sorted(by_bucket)))
            .withColumn("upto", F.sum("w").over(within)).filter(hit).collect())
    at = {}
    for r in rows:
        lo = starts[r["b"]] + r["upto"] - r["w"]
        for rank in by_bucket[r["b"]]:
            if lo <= rank < starts[r["b"]] + r["upto"]:
                at[rank] = r["v"]
    out = []
    for h in places:
        lo, hi = at[math.floor(h)], at[math.ceil(h)]
        out.append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def _bucket_of(v: Column, points: Sequence[float]) -> Column:
    """Number of split points <= v, as a balanced chain of comparisons."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < F.lit(float(points[mid])), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(points))
