"""Retrieval evaluation: rank of the best item of the same entity, Recall@K.

A full similarity sort per query is not needed: the best same-entity score is found first,
then the rows of other entities that beat it are counted.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.scratch import written
from entityvec.functions.shipping import ship, unpack
from entityvec.operators.blocks import (
    MEMBER, BlockSearch, Layout, as_list, as_matrix, candidate_rows, common_order,
    count_better, flat_row, pair_scores, same_group, scores)
from entityvec.operators.splits import cap_queries, per_entity_head

# Reported cut-offs.
TOP_K = (1, 5, 10, 100, 1000)
BROADCAST_VALUES = 4_000_000
SCORE_BYTES = 32 * 1024 * 1024


def retrieval_queries(df: DataFrame, entity: str, item: str, per_entity: int = 4,
                      maximum: int = 512, seed: int = 0) -> DataFrame:
    """Rows of the query items; they are chosen by ids alone, so no vector is shuffled."""
    ids = cap_queries(per_entity_head(df.select(entity, item), entity, item, per_entity), item, maximum, seed)
    if set(df.columns) == {entity, item}:
        return ids
    # At most ``maximum`` keys.
    keys = ids.select(F.col(entity).alias("_e"), F.col(item).alias("_i"))
    same = F.col(entity).eqNullSafe(F.col("_e")) & F.col(item).eqNullSafe(F.col("_i"))
    return df.join(F.broadcast(keys), same, "left_semi")


def _stream(queries, step):
    """Run ``step`` on corpus batches against all queries; one partial result per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unpack(queries)
        state = None
        # Scores of all queries with so many rows take SCORE_BYTES.
        rows = max(1, min(4096, SCORE_BYTES // (8 * max(1, len(q["vec"])))))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                state = step(q, part.column("id"), part.column("grp"),
                             as_matrix(part.column("vec")), state)
        if state is not None:
            yield from state.result()

    return run


class _Best:
    """Best same-group score per query, and the id behind it."""

    def __init__(self, n: int, id_type: pa.DataType):
        self.score, self.id = np.full(n, np.inf), [None] * n
        self.id_type = id_type

    def result(self):
        at = [i for i, x in enumerate(self.id) if x is not None]
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(self.score[at]),
                 pa.array([self.id[i] for i in at], self.id_type)], names=["q", "bound", "best_id"])

    def offer(self, i: int, score: float, key) -> None:
        if score < self.score[i] or (score == self.score[i] and key < self.id[i]):
            self.score[i], self.id[i] = score, key

    def offer_all(self, rows: np.ndarray, score: np.ndarray, at: np.ndarray, ids) -> None:
        """Offer candidates, the best of each query only; equal ones by id."""
        if not len(rows):
            return
        place = common_order(ids, ids[:0])[0]
        order = np.lexsort((place[at], score, rows))
        first = order[np.r_[True, np.diff(rows[order]) > 0]]
        for i, x, j in zip(rows[first], score[first], at[first]):
            self.offer(int(i), float(x), ids[int(j)].as_py())


def _find_best(a, ids, groups, b, b_ids, b_groups, best: _Best) -> _Best:
    """Offer the best row of the same group, other than the query itself, to each query."""
    near = np.nonzero(pc.is_in(b_groups, value_set=groups).to_numpy(zero_copy_only=False))[0]
    if not len(near):
        return best
    take = pa.array(near)
    b, b_ids, b_groups = b[near], b_ids.take(take), b_groups.take(take)
    s, slack = scores(a, b, "dot")
    s[~same_group(groups, b_groups) | same_group(ids, b_ids)] = np.inf
    low = s.min(1) if s.shape[1] else np.full(len(a), np.inf)
    r, j = np.nonzero((s <= (low + slack)[:, None]) & np.isfinite(s))
    best.offer_all(r, pair_scores(a, r, b, j, "dot"), j, b_ids)
    return best


def _best_step(q, ids, groups, b, best):
    best = best or _Best(len(q["vec"]), ids.type)
    return _find_best(q["vec"], pa.array(q["id"], ids.type), pa.array(q["grp"], groups.type),
                      b, ids, groups, best)


class _Counts:
    def __init__(self, n: int):
        self.n = np.zeros(n, np.int64)

    def result(self):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(self.n))), pa.array(self.n)], names=["q", "n"])


def _count_step(q, ids, groups, b, counts):
    counts = counts or _Counts(len(q["vec"]))
    counts.n += count_better(pa.array(q["id"], ids.type), q["vec"], pa.array(q["grp"], groups.type), q["bound"],
                             pa.array(q["best_id"], ids.type), b, groups, ids, "dot")
    return counts


def _best_of_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query pack, row pack) pairs of one entity to the best row per query."""
    for batch in batches:
        asked, rows = (as_list(batch.column(n)) for n in ("asked", "rows"))
        for i in range(batch.num_rows):
            q, c = flat_row(asked, i), flat_row(rows, i)
            best = _find_best(
                as_matrix(q.field("vec")), q.field("id"), q.field("grp"), as_matrix(c.field("vec")),
                c.field("id"), c.field("grp"), _Best(len(q), c.field("id").type))
            for part in best.result():
                yield pa.RecordBatch.from_arrays(
                    [q.field("id").take(part.column("q")), part.column("bound"),
                     part.column("best_id")], names=["id", "bound", "best_id"])


def _packed_by_entity(rows: DataFrame, sizes: DataFrame, name: str, pack_rows: int) -> DataFrame:
    """One row per entity and about ``pack_rows`` of its rows."""
    sub = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / pack_rows))
    return (rows.join(sizes, "grp").withColumn("_sub", sub).groupBy("grp", "_sub")
            .agg(F.collect_list(F.struct(*MEMBER)).alias(name)).drop("_sub"))


def _best_by_entity(corpus: DataFrame, asked: DataFrame, pack_rows: int) -> DataFrame:
    """(id, bound, best_id) for any number of queries.

    Items and queries of an entity meet as packs, a product of matrices each, so even a hot
    entity neither fills one task nor turns into rows of pairs.
    """
    def sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))

    rows = corpus.join(asked.select("grp").distinct(), "grp", "left_semi")
    left = _packed_by_entity(asked, sizes(asked), "asked", pack_rows)
    right = _packed_by_entity(rows, sizes(rows), "rows", pack_rows)
    out = T.StructType([asked.schema["id"], T.StructField("bound", T.DoubleType()),
                        T.StructField("best_id", corpus.schema["id"].dataType)])
    return (left.hint("merge").join(right, "grp").select("asked", "rows")
            .mapInArrow(_best_of_packs, out).groupBy("id")
            .agg(F.min(F.struct("bound", "best_id")).alias("b")).select("id", "b.*"))


def _sent_ranks(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """Ranks with the queries sent to every task; two scans of the corpus, no shuffle of it."""
    spark = corpus.sparkSession
    rows = asked.collect()
    q = {"vec": np.array([r["vec"] for r in rows], dtype=np.float64),
         "grp": [r["grp"] for r in rows], "id": [r["id"] for r in rows]}
    found = T.StructType([T.StructField("q", T.LongType()), T.StructField("bound", T.DoubleType()),
                          T.StructField("best_id", corpus.schema["id"].dataType)])
    best = (corpus.mapInArrow(_stream(ship(spark, q), _best_step), found).groupBy("q")
            .agg(F.min(F.struct("bound", "best_id")).alias("b")).select("q", "b.*").collect())
    bound, best_id = np.full(len(rows), -np.inf), [None] * len(rows)
    for r in best:
        bound[r["q"]], best_id[r["q"]] = r["bound"], r["best_id"]
    q |= {"bound": bound, "best_id": best_id}
    counts = (corpus.mapInArrow(_stream(ship(spark, q), _count_step), "q bigint, n bigint")
              .groupBy("q").agg(F.sum("n").alias("n")))
    names = spark.createDataFrame(
        [(i, r["id"], r["grp"], best_id[i] is not None) for i, r in enumerate(rows)],
        T.StructType([T.StructField("q", T.LongType()), asked.schema["id"], asked.schema["grp"],
                      T.StructField("has", T.BooleanType())]))
    return names.join(counts, "q", "left").select(
        "id", "grp", F.when(F.col("has"), F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def query_ranks(df: DataFrame, queries: DataFrame, item: str, entity: str, vector: str,
                layout: Layout | None = None,
                broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """(item, entity, rank): place of the best same-entity item among all other items.

    Dot product, the query itself left out, equal scores by item id. Null rank: the entity
    has no other item. Queries of up to ``broadcast_values`` numbers are sent to the corpus;
    more are routed to the corpus blocks that can beat them.
    """
    corpus = candidate_rows(df, item, entity, F.col(vector).cast("array<double>"))
    asked = candidate_rows(queries, item, entity, F.col(vector).cast("array<double>"))
    size = asked.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    if not size:
        ranks = asked.select("id", "grp", F.lit(None).cast("bigint").alias("rank"))
    elif size <= broadcast_values:
        ranks = _sent_ranks(corpus, asked)
    else:
        search = BlockSearch(corpus, "dot", layout)
        best = written(_best_by_entity(corpus, asked, search.block_rows), "best")
        counts = search.beaten_by(asked.join(best, "id"))
        ranks = asked.join(counts, "id", "left").select(
            "id", "grp", (F.col("n") + 1).alias("rank"))
    return ranks.select(F.col("id").alias(item), F.col("grp").alias(entity), "rank")


def recall_at_k(ranks: DataFrame, corpus_size: int,
                ks: Sequence[int] = TOP_K) -> DataFrame:
    """(k, recall, query_count); NaN without queries or with a corpus of one item."""
    cuts = sorted(set(ks))
    reach = min(cuts[-1], corpus_size - 1)
    hits = [F.count_if(F.col("rank") <= min(k, reach)).alias(f"h{k}") for k in cuts]
    totals = ranks.agg(F.count(F.lit(1)).alias("query_count"), *hits)
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in cuts])
    usable = (F.col("query_count") > 0) & F.lit(reach > 0)
    return (totals.select("query_count", F.explode(entries).alias("e"))
            .select(F.col("e.k").alias("k"),
                    F.when(usable, F.col("e.hits") / F.col("query_count"))
                    .otherwise(F.lit(float("nan"))).alias("recall"), "query_count"))
