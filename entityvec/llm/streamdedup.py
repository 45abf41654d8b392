"""Exact deduplication as a stateful stream over a growing table of documents."""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import scratch_dir, written
from entityvec.llm.decontaminate import _LOWER, _UPPER

#: Keyed state lives in RocksDB on the executors' disks, with its changes in the checkpoint folder. A partition of it is
#: closed when its task commits, so an executor holds the native memory of the partitions that it works on, not of all.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Input of one micro-batch: a few files for each core of a large cluster.
BATCH_BYTES = str(512 << 30)
#: A file counts as new whatever its date; Spark leaves out those a week older than the newest seen.
FILE_AGE = "36500d"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, content locator and digest of each row of a Parquet scan or stream."""
    text = lowered(F.col("text"))
    # Also where the table has a column of that name itself.
    at = docs.metadataColumn("_metadata")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), at["file_path"].alias("file"),
                       at["row_index"].alias("row"), text.alias("content"),
                       digest(text).alias("digest"))


def _keeper() -> Column:
    """The largest doc_id, a null one only if there is no other; the last row among equals."""
    return F.max(F.struct("doc_id", "file", "row"))


def _as_source(path: str) -> str:
    """A pattern that matches ``path`` alone: streams take patterns and folders, not files."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def update_state(spark: SparkSession, path: str, folder: str, digest: Callable[[Column], Column] = sha256,
                 batch_bytes: str = BATCH_BYTES, batch_files: int | None = None) -> None:
    """Take the files of ``path`` that ``folder`` has not seen into its state.

    For each digest the state holds the count, the identifier that stays and the locator (file
    and row) of its content, for good. Each micro-batch appends the entries it changed to
    ``folder``/changes. A run that was cut off goes on at the micro-batch that it lost.
    """
    size = ("maxFilesPerTrigger", batch_files) if batch_files else ("maxBytesPerTrigger", batch_bytes)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option(*size).option("maxFileAge", FILE_AGE)
    # The partial aggregate of each task sends one row for a digest, however many copies it read.
    entries = (_rows(source.parquet(_as_source(path)), digest).drop("content")
               .groupBy("digest").agg(_keeper().alias("keep"), F.count(F.lit(1)).alias("group_size")))

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        (entries.writeStream.outputMode("update").foreachBatch(append)
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_duplicates(spark: SparkSession, path: str, folder: str | None = None,
                     digest: Callable[[Column], Column] = sha256, batch_bytes: str = BATCH_BYTES,
                     batch_files: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row for every row of the table.

    ``path`` is a Parquet table with doc_id and text; texts are equal when identical after
    lower-casing A-Z, null and empty being the same. Of equal texts the row with the largest
    doc_id stays; of several such rows the one last by file and row, so exactly one row of a
    group has kept true. A null doc_id stays only if the whole group has none (keep_id is then null).
    An empty table gives no rows; other columns are not read, whatever their names. Texts are digested whole, however long.

    ``folder`` holds the state between calls; a fresh one in the shared scratch folder is
    taken by default. Groups of the state are checked on the full bytes of all their rows: where a digest
    has two texts, its rows are grouped by text instead. It is an error if the state lacks rows of the table.
    """
    folder = folder or f"{scratch_dir(spark).rstrip('/')}/entityvec/dedup-{uuid4().hex}"
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return _result(_rows(docs, digest).withColumn("keep", F.struct("doc_id", "file", "row"))
                       .withColumn("group_size", F.lit(0).cast("bigint")), digest)
    update_state(spark, path, folder, digest, batch_bytes, batch_files)
    changes = spark.read.parquet(f"{folder}/changes")
    # Written, so that the join with the rows can split a group that holds much of the table.
    state = written(changes.groupBy("digest").agg(
        F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.*"), "dedup-state")
    counted, n = state.agg(F.sum("group_size")).first()[0] or 0, docs.count()
    if counted < n:
        raise ValueError(f"the state in {folder} has {counted} of {n} rows")
    hits = state.filter("group_size > 1").select("digest")
    rows = _rows(docs, digest)
    clash = (rows.join(sent_if_small(hits), "digest", "left_semi")
             .groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
             .filter("low <> high").select("digest"))
    clash = written(clash, "clashes")
    plain, clashes = rows.select("doc_id", "file", "row", "digest", *_hex(digest)), not clash.isEmpty()
    if clashes:
        plain = plain.join(sent_if_small(clash), "digest", "left_anti")
    # A row that the state does not know is an error, not left out.
    lost = F.when(F.col("group_size").isNull(), F.raise_error(F.concat(F.lit("no state for a row of "), "file")))
    plain = plain.join(state, "digest", "left").withColumn("keep", lost.otherwise(F.col("keep")))
    if not clashes:
        return _result(plain, digest)
    apart = rows.join(sent_if_small(clash), "digest", "left_semi")
    owners = apart.groupBy("digest", "content").agg(_keeper().alias("keep"), F.count(F.lit(1)).alias("group_size"))
    split = apart.join(owners, ["digest", "content"])
    return _result(plain, digest).union(_result(split, digest))


def _hex(digest) -> list[Column]:
    """The text's SHA-256, where the digest is another."""
    return [] if digest is sha256 else [F.sha2("content", 256).alias("hex")]


def _result(rows: DataFrame, digest) -> DataFrame:
    hexed = F.lower(F.hex("digest")) if digest is sha256 else (
        F.col("hex") if "hex" in rows.columns else F.sha2("content", 256))
    own = F.struct("doc_id", "file", "row")
    return rows.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
        own.eqNullSafe(F.col("keep")).alias("kept"), hexed.alias("text_sha256"), "file", "row")
