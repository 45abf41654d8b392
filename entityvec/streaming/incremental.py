"""Incremental jobs as Structured Streaming: new files to vectors, rewards to bandit state."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from entityvec.operators.inference import VectorFn, attempted_vectors
from entityvec.sources.tables import usable_payloads


def table_pattern(path: str) -> str:
    """Pattern that only ``path`` matches, for streams over a table that is one file or a folder of files.

    A stream takes a plain path for the base of partitions, which a file cannot be.
    """
    folder, slash, base = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}[{base[0]}]{base[1:]}"


def stream_inference(spark: SparkSession, input_dir: str, schema: T.StructType,
                     load: Callable[[], VectorFn], out: str, checkpoint: str,
                     payload: str = "image_bytes", key: str = "OSMID",
                     batch_size: int = 32, filter_valid: bool = True,
                     pooling: str = "pooler_output", pattern: str = "*.parquet",
                     files_per_batch: int = 1000) -> StreamingQuery:
    """Vectors of all files not yet processed, then stop; start again to resume.

    The checkpoint remembers the files, the file sink commits each batch atomically. A payload on
    which the model raises gives a row with ``error`` and no vector, so it does not stop the stream.
    """
    source = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .option("pathGlobFilter", pattern).parquet(input_dir))
    rows = usable_payloads(source, payload, key, filter_valid=filter_valid)
    made = attempted_vectors(rows, load, payload, batch_size, pooling)
    return (made.select(key, "embedding", "error").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def bandit_stream(rewards: DataFrame) -> DataFrame:
    """Running state per band of a stream of (band, reward); the state is one row per band."""
    return (rewards.filter(F.col("band") >= 0).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward_sum"))
            .withColumn("mean_reward", F.col("reward_sum") / F.col("n")))


def stream_bandit(rewards: DataFrame, on_update: Callable[[DataFrame, int], None],
                  checkpoint: str) -> StreamingQuery:
    """Hand changed bands to ``on_update`` batch by batch until the input is used up."""
    return (bandit_stream(rewards).writeStream.outputMode("update").foreachBatch(on_update)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
