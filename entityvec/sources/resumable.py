"""Resumable vector jobs: committed chunks are recorded in a ledger and never redone.

A run writes its vectors first and its ledger rows afterwards. Readers only see chunks that
the ledger names, so a run that dies in between leaves no trace in the results. A chunk is
a fixed range of rows of one input file.
"""

import re
import uuid
from collections.abc import Callable, Iterator

from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import scratch_tables, written
from entityvec.operators.inference import VectorFn, pool_output
from entityvec.sources.tables import usable_payloads

LEDGER = ("run_id string, input_path string, model_id string, filter_valid boolean, "
          "chunk string, rows bigint, status string")
# States after which a chunk is not tried again.
FINAL_STATES = ("done", "empty", "failed")
IDENTITY = ("input_path", "model_id", "filter_valid")


def relative_file(input_path: str):
    """Name of a row's file below ``input_path``: equal base names in two folders stay apart.

    A file given by its own path has its base name, and one found by a pattern its whole path.
    """
    root = quote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "", input_path.rstrip("/")), safe="/=:@!$&'()*+,;~-._")
    path = F.col("_metadata.file_path")
    at = F.instr(path, root + "/")
    return (F.when(at > 0, F.substring(path, at + len(root) + 1, F.length(path)))
            .when(path.endswith(root), F.col("_metadata.file_name")).otherwise(path))


def chunk_of(file_name, row_index, chunk_rows: int):
    """Stable name of the chunk that holds a row of a file."""
    return F.concat_ws("#", file_name, F.floor(row_index / chunk_rows).cast("bigint").cast("string"))


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def check_ledger(ledger: DataFrame, input_path: str, model_id: str, filter_valid: bool) -> None:
    """Refuse to mix results of another input, model or filter."""
    wanted = dict(zip(IDENTITY, (input_path, model_id, filter_valid)))
    same = F.lit(True)
    for name, value in wanted.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    other = ledger.filter(~same).select(*IDENTITY).limit(1).collect()
    if other:
        raise ValueError(f"the output holds results of {other[0].asDict()}, not of {wanted}")


def final_chunks(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin(*FINAL_STATES)).select("chunk").distinct()


def pending_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of chunks that have no final state; also of chunks never seen.

    The rows carry payloads, so the chunk names go to the rows while they are few enough.
    """
    return rows.join(sent_if_small(final_chunks(ledger)), "chunk", "left_anti")


def chunk_states(attempts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, rows, status) of a run from its per-row attempts.

    No usable row: ``empty``. All rows failed: ``failed`` (not tried again). Some failed:
    ``partial`` (nothing committed, tried again). Otherwise ``done``.
    """
    per_chunk = attempts.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("good"))
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("good", F.lit(0))
    status = (F.when(n == 0, "empty").when(good == 0, "failed")
              .when(good < n, "partial").otherwise("done"))
    return (chunks.join(per_chunk, "chunk", "left")
            .select("chunk", F.when(status == "done", good).otherwise(0).cast("bigint").alias("rows"),
                    status.alias("status")))


def _attempt(load: Callable[[], VectorFn], batch_size: int, pooling: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            for chunk, part in frame.groupby("chunk", sort=False):
                for i in range(0, len(part), batch_size):
                    some = part.iloc[i:i + batch_size]
                    out = pd.DataFrame({"chunk": chunk, "key": some["key"].to_numpy()})
                    try:
                        made = pool_output(model(some["payload"].tolist()), pooling)
                        if len(made) != len(some):
                            raise ValueError("the model returned another number of vectors")
                        out["embedding"] = pd.Series(list(np.asarray(made)), dtype=object)
                        out["error"] = None
                    except Exception as e:
                        out["embedding"] = None
                        out["error"] = f"{type(e).__name__}: {e}"
                    yield out

    return run


def attempt_vectors(rows: DataFrame, load: Callable[[], VectorFn], batch_size: int = 32,
                    pooling: str = "pooler_output") -> DataFrame:
    """``chunk, key, embedding, error`` for rows ``chunk, key, payload``."""
    schema = T.StructType([
        T.StructField("chunk", T.StringType()), T.StructField("key", rows.schema["key"].dataType),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType())])
    return (rows.select("chunk", "key", "payload")
            .mapInPandas(_attempt(load, batch_size, pooling), schema))


def packaged_inference(spark: SparkSession, input_path: str, out: str,
                       load: Callable[[], VectorFn], model_id: str, batch_size: int = 32,
                       limit: int | None = None, filter_valid: bool = True,
                       chunk_rows: int = 1000, key: str = "OSMID",
                       payload: str = "image_bytes") -> DataFrame:
    """Run a model over the pending chunks of a packaged-image table; returns the new
    ledger rows. Repeat it to resume.

    ``limit`` bounds the committed vectors, earlier runs included. The chunk that crosses it
    is committed as ``cut`` with its first rows only and redone whole by a later run with
    more room, which then replaces them.
    """
    with scratch_tables(spark):
        run_id = _run_pending(spark, input_path, out, load, model_id, batch_size, limit, filter_valid, chunk_rows, key, payload)
    return spark.read.schema(LEDGER).parquet(f"{out}/ledger").filter(F.col("run_id") == run_id)


def _run_pending(spark: SparkSession, input_path: str, out: str, load: Callable[[], VectorFn], model_id: str,
                 batch_size: int, limit: int | None, filter_valid: bool, chunk_rows: int, key: str, payload: str) -> str:
    """Vectors and ledger rows of one run; returns the run's id."""
    ledger = read_ledger(spark, out)
    check_ledger(ledger, input_path, model_id, filter_valid)
    source = spark.read.parquet(input_path)
    name = chunk_of(relative_file(input_path), F.col("_metadata.row_index"), chunk_rows)
    rows = source.select("*", name.alias("chunk"), F.col("_metadata.row_index").alias("row"))
    todo = pending_rows(rows, ledger)
    chunks = todo.select("chunk").distinct()
    usable = usable_payloads(todo, payload, key, filter_valid=filter_valid, keep=("chunk", "row")).select(
        "chunk", "row", F.col(key).alias("key"), F.col(payload).alias("payload"))
    cut = None
    if limit is not None:
        chunks, cut = _within_limit(chunks, usable, ledger, limit)
        whole = usable.join(chunks, "chunk", "left_semi")
        if cut is None:
            usable = whole
        else:
            usable = whole.unionByName(
                usable.filter(F.col("chunk") == cut[0]).orderBy("row").limit(cut[1]))
            chunks = chunks.unionByName(spark.createDataFrame([(cut[0],)], "chunk string"))
    run_id = uuid.uuid4().hex
    part = f"{out}/attempts/run_id={run_id}"
    attempt_vectors(usable, load, batch_size).write.parquet(part)
    attempts = spark.read.parquet(part)
    states = chunk_states(attempts, chunks).filter("status != 'partial'")
    if cut is not None:
        states = states.withColumn("status", F.when(
            (F.col("chunk") == cut[0]) & (F.col("status") == "done"), "cut")
            .otherwise(F.col("status"))).filter(
            ~((F.col("chunk") == cut[0]) & (F.col("status") == "failed")))
    entries = states.select(
        F.lit(run_id).alias("run_id"), F.lit(input_path).alias("input_path"),
        F.lit(model_id).alias("model_id"), F.lit(filter_valid).alias("filter_valid"),
        "chunk", "rows", "status")
    entries.write.mode("append").parquet(f"{out}/ledger")
    return run_id


def _within_limit(chunks: DataFrame, usable: DataFrame, ledger: DataFrame,
                  limit: int) -> tuple[DataFrame, tuple[str, int] | None]:
    """Pending chunks in name order that fit whole, and the (chunk, rows) cut by the limit."""
    done, cut = ledger.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("rows"))), F.lit(0)),
        F.coalesce(F.max(F.when(F.col("status") == "cut", F.col("rows"))), F.lit(0))).first()
    room = max(limit - done, 0) if done + cut < limit else 0
    sizes = written(usable.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")), "chunk-sizes")
    if sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= room:
        return chunks, None
    # Names in order over range partitions: only a sum for each partition is gathered.
    parts = written(sizes.repartitionByRange("chunk").withColumn("_part", F.spark_partition_id()), "chunk-ranges")
    before = (parts.groupBy("_part").agg(F.sum("n").alias("_all"))
              .withColumn("_before", F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).drop("_all"))
    inside = Window.partitionBy("_part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    summed = (parts.join(F.broadcast(before), "_part")
              .withColumn("_sum", F.sum("n").over(inside) + F.col("_before")))
    crossing = (summed.filter((F.col("_sum") > room) & (F.col("_sum") - F.col("n") < room))
                .select("chunk", (room - F.col("_sum") + F.col("n")).alias("m")).collect())
    whole = summed.filter(F.col("_sum") <= room).select("chunk")
    return whole, (crossing[0]["chunk"], crossing[0]["m"]) if crossing else None


def read_vectors(spark: SparkSession, out: str, key: str = "OSMID") -> DataFrame:
    """Committed vectors only; a whole chunk replaces its earlier cut version."""
    rank = F.when(F.col("status") == "done", 0).otherwise(1)
    valid = (read_ledger(spark, out).filter(F.col("status").isin("done", "cut"))
             .groupBy("chunk").agg(F.min(F.struct(rank.alias("r"), -F.col("rows"), "run_id")).alias("b"))
             .select("chunk", F.col("b.run_id").alias("run_id")))
    return (spark.read.parquet(f"{out}/attempts").join(valid, ["run_id", "chunk"], "left_semi")
            .select(F.col("key").alias(key), "embedding"))

