"""Connected components of an edge table by union-find in tasks and alternating stars."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityvec.functions.scratch import written


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node to the smallest node it is joined with inside a batch."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.int64()) for i in (1, 0)], names=["a", "b"])


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step of the alternating star algorithm; a < b in every edge, in and out."""
    if larger:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    # Written, so that the join can split a hub that very many edges meet in.
    least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    linked = sides.join(least, "u")
    if larger:
        linked = linked.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        linked = linked.filter(F.col("v") != F.col("m")).select(
            F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.filter("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
    return linked.filter("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                           F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, component being its smallest node.

    ``edges`` has integer columns a and b; nulls and loops are left out. Each task first
    contracts its edges to a forest, then large and small stars alternate until nothing
    changes; every round is a written table, so a lost executor repeats one round at most.
    """
    ordered = edges.filter("a <> b").select(
        F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b"))
    now = written(ordered.mapInArrow(_forests, "a bigint, b bigint").distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        now = written(_star(_star(now, True), False), "edges")
        if (state := _state(now)) == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
