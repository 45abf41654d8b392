"""Parquet inputs: shards, fingerprints and packaged images; partitioned outputs."""

import json
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from entityvec.functions.schema import HELPER_COLUMNS, require_columns

FINGERPRINT_SCHEMA = T.StructType([
    T.StructField("streetview_image_id", T.StringType()),
    T.StructField("building_id", T.StringType()),
    T.StructField("fingerprint", T.ArrayType(T.LongType())),
])


#: Tasks that image files are read by, more only on a cluster with more cores than an eighth of it.
READING_TASKS = 512


def read_parquet_dir(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                     pattern: str = "*.parquet", required: Sequence[str] = (),
                     file_name: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Files of a folder that match ``pattern``; an error when there is none.

    ``file_name`` adds the shard's file name under that name. ``types`` names columns that files may store in
    different types and the type to read them as; a file with a damaged footer is an error then, too.
    """
    if types:
        groups, bad = files_by_schema(spark, path, pattern)
        if bad:
            raise ValueError(f"files that cannot be read: {', '.join(bad)}")
        parts = [_picked(spark.read.parquet(*files), path, columns, required, file_name, types) for files in groups]
        return reduce(DataFrame.unionByName, parts)
    try:
        df = spark.read.option("pathGlobFilter", pattern).parquet(path)
    except AnalysisException as e:
        raise ValueError(f"no readable {pattern} in {path}") from e
    return _picked(df, path, columns, required, file_name, {})


def _picked(df: DataFrame, path: str, columns: Sequence[str] | None, required: Sequence[str],
            file_name: str | None, types: dict[str, str]) -> DataFrame:
    require_columns(df, [*required, *(columns or []), *types], path)
    picked = [F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in (columns or df.columns)]
    if file_name:
        picked.append(F.col("_metadata.file_name").alias(file_name))
    return df.select(*picked)


def _footer(path: str) -> str:
    """Names and types of a file's columns, as text."""
    if path.startswith("file:"):
        store, inner = fs.LocalFileSystem(), unquote("/" + path.removeprefix("file:").lstrip("/"))
    else:
        store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return json.dumps([(c.name, str(c.type)) for c in pq.read_schema(f)])


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schemas, errors = [], []
        for path in batch.column(0).to_pylist():
            try:
                schemas.append(_footer(path))
                errors.append(None)
            except Exception as e:  # whatever a damaged footer raises
                schemas.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:500])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(schemas, pa.string()), pa.array(errors, pa.string())], names=["file", "columns", "error"])


def file_footers(spark: SparkSession, files: Sequence[str], per_task: int = 64) -> DataFrame:
    """file, columns, error of Parquet files: footers are read by tasks, some files each.

    ``columns`` is the JSON text of the names and types; a file whose footer cannot be read has an error instead.
    Executors must reach the files by their URI.
    """
    listed = spark.createDataFrame([(f,) for f in sorted(files)], "file string")
    return listed.repartition(max(1, -(-len(files) // per_task))).mapInArrow(_footers, "file string, columns string, error string")


def files_by_schema(spark: SparkSession, path: str, pattern: str = "*.parquet") -> tuple[list[list[str]], list[str]]:
    """(files grouped by their own schema, files whose footer cannot be read) of a folder, by one job."""
    try:
        files = spark.read.schema(FINGERPRINT_SCHEMA).option("pathGlobFilter", pattern).parquet(path).inputFiles()
    except AnalysisException as e:
        raise ValueError(f"no readable {pattern} in {path}") from e
    if not files:
        raise ValueError(f"no readable {pattern} in {path}")
    groups: dict[str, list[str]] = {}
    skipped = []
    # One short row for each file.
    for r in sorted(file_footers(spark, files).collect()):
        if r["error"] is None:
            groups.setdefault(r["columns"], []).append(r["file"])
        else:
            skipped.append(r["file"])
    return list(groups.values()), skipped


def read_fingerprints(spark: SparkSession, path: str, skipped: list[str] | None = None) -> DataFrame:
    """Fingerprint shards, ids as text whatever type a shard stores them in.

    A file whose footer is damaged is left out: its name is appended to ``skipped``, and
    warned of without that list. Having no other file is an error. Damage inside a file fails the job that reads it.
    """
    by_schema, bad = files_by_schema(spark, path)
    if bad and skipped is None:
        warnings.warn(f"fingerprint files that cannot be read: {', '.join(bad)}", stacklevel=2)
    elif bad:
        skipped += bad
    parts = []
    for files in by_schema:
        df = spark.read.parquet(*files)
        require_columns(df, FINGERPRINT_SCHEMA.names, files[0])
        parts.append(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FINGERPRINT_SCHEMA]))
    if not parts:
        raise ValueError(f"no fingerprint could be read from {path}")
    return reduce(DataFrame.union, parts)


def read_image_files(spark: SparkSession, path: str, decoded: bool = True) -> DataFrame:
    """``file, dir, stem, ext, content`` of all files below a folder, the input of image checks and fingerprints.

    ``content`` is the struct of Spark's ``image`` source (height -1 for a file that no codec of the JVM reads), or
    with ``decoded`` false the bytes. Files are read by the tasks, many small ones in each.
    """
    reader = spark.read.format("image" if decoded else "binaryFile").option("recursiveFileLookup", "true")
    # Spark plans 32 small files for a task at most, so very many tasks.
    files = reader.load(path).coalesce(max(READING_TASKS, 8 * spark.sparkContext.defaultParallelism))
    if decoded:
        files = files.select(F.col("image.origin").alias("path"), F.col("image").alias("content"))
    # The two sources spell the path's scheme and blanks each in their own way.
    name = F.url_decode(F.replace(F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    base = F.substring_index(name, "/", -1)
    dot = F.length(base) - F.locate(".", F.reverse(base))
    named = F.contains(base, F.lit(".")) & (dot > 0)
    return files.select(
        name.alias("file"), F.substring_index(F.regexp_replace(name, "/[^/]*$", ""), "/", -1).alias("dir"),
        F.when(named, F.substring(base, F.lit(1), dot)).otherwise(base).alias("stem"),
        F.when(named, F.substring(base, dot + 1, F.length(base))).otherwise("").alias("ext"), "content")


def usable_payloads(df: DataFrame, payload: str = "image_bytes", key: str = "OSMID",
                    valid: str = "is_valid", filter_valid: bool = True,
                    keep: Sequence[str] = ()) -> DataFrame:
    """(key, payload) of valid rows with a non-empty payload; a missing key column is null.

    ``keep`` names further columns to return before them.
    """
    require_columns(df, [payload], "packaged images")
    out = df
    if filter_valid and valid in df.columns:
        out = out.filter(F.col(valid).eqNullSafe(True))
    out = out.filter(F.length(payload) > 0)
    own = F.col(key) if key in df.columns else F.lit(None).cast("bigint").alias(key)
    return out.select(*keep, own, payload)


def read_packaged_images(spark: SparkSession, path: str, filter_valid: bool = True) -> DataFrame:
    return usable_payloads(spark.read.parquet(path), filter_valid=filter_valid)


def write_shards(df: DataFrame, path: str, shard: str = "dataset_id",
                 mode: str = "errorifexists", observation: Observation | None = None, *counts: Column,
                 tasks: int | None = None) -> None:
    """One folder per shard; a shard without rows writes nothing.

    Rows are rebalanced by shard: small shards get one file, adaptive execution gives a big
    one several writers. ``counts`` are aggregates of the rows as they are written, for ``observation``: by the
    writing tasks themselves, so that a repeated shuffle task counts nothing twice. Very many small shards
    cost by their number, not by their bytes, which alone adaptive execution looks at: ``tasks`` deals whole shards over so many writers.
    """
    out = df.repartition(tasks, shard) if tasks else df.hint("rebalance", shard)
    if observation is not None:
        out = out.observe(observation, *counts)
    out.write.mode(mode).partitionBy(shard).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int | None = None) -> DataFrame:
    """Table ``name`` under ``path``, dealt into buckets by ``key`` and sorted in each; returns a scan of it.

    A join or grouping on the key then needs no shuffle of this table: worth it for wide rows that are read again
    and again. There are as many buckets as the session has shuffle partitions, else Spark would deal the rows anew.
    Each bucket is one file, so choose a number that gives buckets of some hundred MB.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(name))
    return spark.table(name)


def write_splits(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of the splits without helper columns, one folder per split.

    Rows are rebalanced by split: files get the size that adaptive execution aims at, however many tasks made
    the rows, and a big split has many writers.
    """
    kept = [c for c in rows.columns if c not in HELPER_COLUMNS]
    rows.select(*kept).hint("rebalance", "split").write.mode(mode).partitionBy("split").parquet(path)
