"""Intermediate tables written to the shared checkpoint folder, to cut lineage once."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_default: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only for local sessions without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_default:
        _local_default.append(tempfile.mkdtemp(prefix="entityvec-"))
    return _local_default[0]


_folders: list[str] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that :func:`written` makes inside: they are deleted at the end.

    A frame that is built on them must be written or collected inside as well.
    """
    _folders.append(f"{scratch_dir(spark).rstrip('/')}/entityvec/run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of it.

    The table goes with the innermost :func:`scratch_tables`, else it stays until the scratch folder is cleared.
    """
    spark = df.sparkSession
    folder = _folders[-1] if _folders else f"{scratch_dir(spark).rstrip('/')}/entityvec"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
