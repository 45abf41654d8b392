"""Nearest vectors by multi-index hashing of learned binary codes.

Vectors are turned by rotations learned on a bounded sample (iterative quantization), and the signs of
the turned vector are its code. A code is cut into ``m`` substrings, and every row is indexed under
each. Codes within Hamming distance r agree with the query's in one substring to within r / m (pigeonhole), so the
substrings' indexes give all of them; their vectors are then compared as they are.

A substring's index is dealt into shards by its first bits. A query goes to the shards whose bits are
near enough to its own; inside, a task looks up the values near enough and the rows that hold them.
The radius is that of the neighbours of a few queries, found by going over all rows. Queries that find too few
rows get a larger radius, the last one being that of all codes.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.hashing import keyed_hash
from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import written
from entityvec.functions.shipping import ship, unpack
from entityvec.operators.ranking import take_by_hash

#: Bits of a code and its substrings (of 63 bits at most).
BITS, SUBSTRINGS = 128, 3
#: Rows that rotations are learned on (fewer if they are wide) and queries whose neighbours give the radius.
LEARNED_ROWS, LEARNED_BYTES, PROBES, ROUNDS = 8192, 32 << 20, 128, 30
#: Share of the probes' neighbours that lie within the radius.
REACHED = 0.98
#: Rows of a shard, queries that meet it at once, and most bits that shards are dealt by.
SHARD_ROWS, SHARD_QUERIES, SHARD_BITS = 16_384, 16_384, 20
#: Pairs of query and row that a task looks at together.
PAIRS = 1 << 20


class Codes:
    """Rotations of vectors of one width, and the substrings of the signs."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, substrings: int = SUBSTRINGS, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        turns, width = [], min(sample.shape[1], 64)
        while sum(t.shape[1] for t in turns) < bits:
            turn = np.linalg.qr(draw.standard_normal((sample.shape[1], width)))[0]
            flat = centred @ turn
            # Turned inside its span until the signs lie as near to the vectors as can be.
            spin = np.eye(width)
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(flat @ spin >= 0, 1.0, -1.0).T @ flat)
                spin = (u @ v).T
            turns.append(turn @ spin)
        self.turn = np.hstack(turns)[:, :bits]
        self.sizes = [len(x) for x in np.array_split(np.arange(bits), substrings)]
        self.bits = bits

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, substrings) of unsigned numbers."""
        signs = (vectors - self.mean) @ self.turn >= 0
        out, start = np.zeros((len(vectors), len(self.sizes)), np.uint64), 0
        for i, size in enumerate(self.sizes):
            weights = np.uint64(1) << np.arange(size, dtype=np.uint64)[::-1]
            out[:, i] = np.where(signs[:, start:start + size], weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            start += size
        return out

    def radii(self, radius: int) -> list[int]:
        """Largest distance in each substring that must be looked up; -1 where none need be."""
        if radius >= self.bits:
            return [self.sizes[0]] + [-1] * (len(self.sizes) - 1)
        each, more = divmod(radius, len(self.sizes))
        return [each if i <= more else each - 1 for i in range(len(self.sizes))]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vec) of rows with an id and a finite vector other than zero, of the width that most have; one row for each id."""
    vec = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select(F.col(f"`{id}`").cast("bigint").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda x: x != 0))
    widths = good.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return good
    good = good.filter(F.size("vec") == widths[0]["w"])
    repeated = written(good.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return good
    one = good.join(sent_if_small(repeated), "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))
    return good.join(sent_if_small(repeated), "id", "left_anti").union(one)


def _encoder(sent):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = unpack(sent)
        for batch in batches:
            if batch.num_rows:
                made = codes.encode(_matrix(batch.column("vec"))).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "code"])
    return encode


def _prober(sent, k: int):
    """For each probe the best rows of a task, with the Hamming distance of their codes."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, vectors = unpack(sent)
        own = codes.encode(vectors)
        found = {i: [] for i in range(len(ids))}
        for batch in batches:
            if not batch.num_rows:
                continue
            other, rows = batch.column("id").to_numpy(), _matrix(batch.column("vec"))
            scores, code = vectors @ rows.T, codes.encode(rows)
            for i, kept in found.items():
                at = np.flatnonzero(other != ids[i])
                at = at[np.argsort(-scores[i][at], kind="stable")[:k]]
                far = np.bitwise_count(code[at] ^ own[i]).sum(axis=1)
                kept += zip(scores[i][at].tolist(), far.tolist())
                kept.sort(reverse=True)
                del kept[k:]
        rows = [(int(ids[i]), s, int(far)) for i, kept in found.items() for s, far in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
             pa.array([r[2] for r in rows], pa.int64())], names=["probe", "score", "far"])
    return probe


def _radius(rows: DataFrame, queries: DataFrame, codes: Codes, k: int) -> int:
    """Hamming distance within which ``REACHED`` of the probes' true neighbours lie."""
    some = take_by_hash(queries, "id", 1, lambda n: PROBES)[0].orderBy("id").collect()
    ids, vectors = np.array([r["id"] for r in some], np.int64), np.array([r["vec"] for r in some], np.float64)
    sent = ship(rows.sparkSession, (codes, ids, vectors))
    near = rows.mapInArrow(_prober(sent, k), "probe bigint, score double, far bigint")
    first = Window.partitionBy("probe").orderBy(F.desc("score"))
    counts = (near.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
              .groupBy("far").count().orderBy("far").collect())
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= REACHED * total:
            return int(r["far"])
    return codes.bits


def _masks(size: int, radius: int) -> np.ndarray:
    """Numbers of ``size`` bits with at most ``radius`` of them set."""
    if radius >= size:
        return np.arange(1 << size, dtype=np.int64)
    return np.array([sum(1 << b for b in some) for n in range(max(radius, -1) + 1) for some in combinations(range(size), n)], np.int64)


def _shard(value: Column, size: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, size - bits) if bits else F.lit(0).cast("bigint")


def _visitor(sizes: list[int], radii: list[int], bits: int):
    """Queries to the shards that may hold codes near enough."""
    masks = [_masks(bits, r) for r in radii]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, some in enumerate(masks):
                if not len(some):
                    continue
                own = code[:, i].view(np.uint64) >> np.uint64(sizes[i] - bits)
                step = max(1, (1 << 14) // len(some))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    shards = (own[start:start + step].astype(np.int64)[:, None] ^ some[None, :]).reshape(-1)
                    rows = pa.array(np.repeat(np.arange(part.num_rows), len(some)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(shards), i, np.int32)), pa.array(shards), *(c.take(rows) for c in part.columns)],
                        names=["i", "shard", *batch.schema.names])
    return visit


def _searcher(radius: int, radii: list[int], k: int):
    """The k nearest rows of a shard for each query, among those within the radius."""
    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            i = key[0].as_py()
            ids, vectors, code = _columns(rows)
            order = np.lexsort((ids, code[:, i]))
            ids, vectors, code = ids[order], vectors[order], code[order]
            values, starts, sizes = np.unique(code[:, i], return_index=True, return_counts=True)
            own_ids, own_vectors, own_code = _columns(queries)
            step = max(1, PAIRS // len(ids))
            for a in range(0, len(own_ids), step):
                some = slice(a, a + step)
                q, v = np.nonzero(np.bitwise_count(own_code[some, i][:, None] ^ values[None, :]) <= radii[i])
                # Every row that holds one of the values.
                n = sizes[v]
                q = np.repeat(q, n)
                r = np.repeat(starts[v] - np.cumsum(n) + n, n) + np.arange(len(q))
                far = sum(np.bitwise_count(own_code[some][q, j] ^ code[r, j]).astype(np.int64) for j in range(code.shape[1]))
                good = (far <= radius) & (ids[r] != own_ids[some][q])
                _ranked(own_ids[some], own_vectors[some], q[good], ids, vectors, r[good], k, out)
        made = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"query_id": pa.array(made[0], pa.int64()), "vec_id": pa.array(made[1], pa.int64()),
                         "score": pa.array(made[2], pa.float64())})
    return search


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    code = table.column("code").combine_chunks().flatten().to_numpy().view(np.uint64)
    return (table.column("id").to_numpy(), _matrix(table.column("vec").combine_chunks()), code.reshape(table.num_rows, -1))


def _ranked(own_ids, own_vectors, q, ids, vectors, r, k, out) -> None:
    """Appends the k best of the pairs (q, r), q ascending, of each query."""
    score = np.empty(len(q))
    step = max(1, PAIRS // vectors.shape[1])
    for a in range(0, len(q), step):
        some = slice(a, a + step)
        # Row by row in one order of summing, so that equal vectors have equal scores.
        score[some] = (own_vectors[q[some]] * vectors[r[some]]).sum(axis=1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    for column, values in zip(out, (own_ids[q[keep]], ids[r[keep]], score[keep])):
        column.append(values)


def nearest_by_codes(rows: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``rows`` where ``is_query`` (of column ``id``) the k nearest other rows found.

    Nearness is the inner product of the vectors in double precision, ties go to the smaller id. A query gets k rows, or
    all others if there are fewer; they are the nearest of those whose code lies within its radius, which
    holds about 98 % of the true neighbours.

    Vectors that are null, zero or empty or hold null or non-finite numbers take no part, nor do rows without id or of
    another width than most (the smallest such, if several are as frequent). Rows of one id are one, with the least of their
    vectors. An empty table gives no rows. Columns other than the two named are not read. Vectors of any width are
    worked on, in shards of at most 16,384 rows.
    """
    spark = rows.sparkSession
    good = _usable(rows, id, vector)
    total = good.count()
    out_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                               T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    queries = good.filter(is_query)
    if total < 2 or queries.isEmpty():
        return spark.createDataFrame([], out_schema)
    width = good.select(F.size("vec")).first()[0]
    learned = max(2, min(LEARNED_ROWS, LEARNED_BYTES // (8 * width)))
    sample = take_by_hash(good, "id", 0, lambda n: learned)[0].orderBy(keyed_hash(0, "id")).collect()
    codes = Codes(np.array([r["vec"] for r in sample], np.float64))
    sent, sizes = ship(spark, codes), codes.sizes
    coded_schema = T.StructType([*good.schema.fields, T.StructField("code", T.ArrayType(T.LongType()))])
    coded = good.mapInArrow(_encoder(sent), coded_schema)
    bits = min(SHARD_BITS, max(0, (total // SHARD_ROWS).bit_length() - 1))
    every = F.array(*[F.struct(F.lit(i).alias("i"), _shard(F.get("code", i), n, bits).alias("shard")) for i, n in enumerate(sizes)])
    # Without vectors: only the sizes of the shards are wanted here.
    filled = written(coded.select(F.explode(every).alias("x")).groupBy("x.i", "x.shard").agg(F.count(F.lit(1)).alias("n")), "shards")
    asked = written(coded.filter(is_query), "queries")
    radius, wanted, done = _radius(good, queries, codes, k), min(k, total - 1), []
    while True:
        radii = codes.radii(radius)
        found = _round(coded, asked, filled, every, radius, radii, sizes, bits, k)
        found = written(found, "found")
        full = written(found.groupBy("query_id").agg(F.max("rank").alias("_n")).filter(F.col("_n") >= wanted).select("query_id"), "full")
        done.append(found.join(sent_if_small(full), "query_id", "left_semi"))
        asked = written(asked.join(full.withColumnRenamed("query_id", "id"), "id", "left_anti"), "queries")
        if radius >= codes.bits or asked.isEmpty():
            break
        radius = min(codes.bits, 2 * radius + 8)
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    return result.select("query_id", "rank", "vec_id", "score")


def _round(coded: DataFrame, asked: DataFrame, filled: DataFrame, every: Column, radius: int, radii: list[int],
           sizes: list[int], bits: int, k: int) -> DataFrame:
    """The k nearest rows within the radius of each query."""
    visits = asked.mapInArrow(_visitor(sizes, radii, bits), T.StructType(
        [T.StructField("i", T.IntegerType()), T.StructField("shard", T.LongType()), *asked.schema.fields]))
    visits = written(visits.join(filled.select("i", "shard"), ["i", "shard"], "left_semi"), "visits")
    # A hot shard is cut into parts, and its queries too; each part of one meets each of the other.
    plan = written(visits.groupBy("i", "shard").agg(F.count(F.lit(1)).alias("_q")).join(filled, ["i", "shard"]).select(
        "i", "shard", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("parts"), F.ceil(F.col("_q") / SHARD_QUERIES).cast("int").alias("lots")), "plan")
    plan = sent_if_small(plan)

    def dealt(by: str, over: str):
        mine = F.pmod(F.xxhash64("id"), F.col(by)).cast("int")
        return mine, F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    part, lots = dealt("parts", "lots")
    left = (coded.select("id", "vec", "code", F.explode(every).alias("x")).select("id", "vec", "code", "x.i", "x.shard")
            .join(plan, ["i", "shard"]).withColumn("part", part).withColumn("lot", lots).select("i", "shard", "part", "lot", "id", "vec", "code"))
    lot, parts = dealt("lots", "parts")
    right = (visits.join(plan, ["i", "shard"]).withColumn("lot", lot).withColumn("part", parts)
             .select("i", "shard", "part", "lot", "id", "vec", "code"))
    keys = ["i", "shard", "part", "lot"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _searcher(radius, radii, k), "query_id bigint, vec_id bigint, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.repartition("query_id").dropDuplicates(["query_id", "vec_id"])
            .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
