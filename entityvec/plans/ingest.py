"""Archives to intermediate rows, and intermediate rows to fingerprints."""

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entityvec.functions import ids
from entityvec.functions.joins import sent_if_small
from entityvec.functions.schema import require_columns
from entityvec.functions.scratch import scratch_tables, written
from entityvec.operators.images import FINGERPRINT_SIZE, Decoder, pixel_fingerprint, validate_images
from entityvec.operators.inference import VectorFn, attempted_vectors
from entityvec.operators.ingest import (
    IMAGE_SUFFIXES, ingest_stats, intermediate_rows, match_paths, pair_metadata_images)
from entityvec.operators.keysets import keep_keys
from entityvec.operators.neighbors import DIFFICULTY_COLUMNS
from entityvec.operators.splits import sample_entities
from entityvec.sources.archives import list_archive_members, read_members, texts_of
from entityvec.sources.tables import write_shards


def archive_outcomes(spark: SparkSession, paths: Iterable[str],
                     decode: Decoder | None = None) -> DataFrame:
    """Every metadata file of the archives with parsed fields, ``ext`` and ``outcome``.

    Archives whose name is not a number give nothing, as they have no dataset id. Each archive is listed once.
    """
    known = [p for p in dict.fromkeys(paths) if _has_dataset(p)]
    if len({p.rpartition("/")[2] for p in known}) < len(known):
        raise ValueError("archives of one name in several folders: their members could not be told apart")
    members = written(list_archive_members(spark, known), "members")
    text = texts_of(read_members(members.filter("ext = '.txt'")))
    meta = ids.parse_metadata_line(text, "text", ids.shard_id(F.col("tar_file"))).drop("text")
    pictures = read_members(members.filter(F.col("ext").isin(*IMAGE_SUFFIXES)))
    images = validate_images(pictures, "content", decode)
    return pair_metadata_images(meta, images.select("tar_file", "dir", "stem", "ext", "ok"))


def _has_dataset(path: str) -> bool:
    return path.rpartition("/")[2].split(".", 1)[0].isdigit()


def ingest_archives(spark: SparkSession, paths: Iterable[str], out: str,
                    decode: Decoder | None = None) -> DataFrame:
    """Archives to intermediate rows under ``out`` (a folder per dataset); returns a row of stats per archive.

    An archive that is damaged, or whose name is no number, has zeros and ``read`` false.
    """
    paths = list(paths)
    asked = spark.createDataFrame([(p.rpartition("/")[2],) for p in paths], "tar_file string").distinct()
    with scratch_tables(spark):
        outcomes = written(archive_outcomes(spark, paths, decode), "outcomes")
        stats = written(ingest_stats(outcomes), "stats")
        made = intermediate_rows(outcomes)
        write_shards(made, out, tasks=_even_tasks(spark, stats))
        counts = [c for c in stats.columns if c != "tar_file"]
        full = asked.join(stats, "tar_file", "left").select(
            "tar_file", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.col(counts[0]).isNotNull().alias("read"))
        # As many rows as paths were given.
        return spark.createDataFrame(full.collect(), full.schema)


def _even_tasks(spark: SparkSession, stats: DataFrame) -> int | None:
    """Tasks to deal the datasets over as wholes; None if they are few, or one has so many rows that it wants several writers."""
    sizes = stats.groupBy(ids.shard_id(F.col("tar_file"))).agg(F.sum("valid_entries").alias("n"))
    count, total, largest = sizes.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.max("n")).first()
    tasks = 4 * spark.sparkContext.defaultParallelism
    return tasks if count >= 4 * tasks and largest * tasks <= total else None


def _matched(rows: DataFrame, files: DataFrame, seen: Observation) -> DataFrame:
    """The rows with their matched paths, counted while they are written."""
    found = F.col("path_status") == "ok"
    return written(match_paths(rows, files.select("shard", "file")).observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(found).alias("found")), "matched")


def _totals(spark: SparkSession, seen: Observation, successful: int) -> DataFrame:
    """The one row of a job's statistics, from what its writing passes have counted."""
    total, found = seen.get["total"], seen.get["found"]
    return spark.createDataFrame([(total, successful, total - successful, total - found)],
                                 "total_entries bigint, successful bigint, failed bigint, missing bigint")


def embedding_job(rows: DataFrame, files: DataFrame, load: Callable[[], VectorFn], out: str,
                  batch_size: int = 32, pooling: str = "cls_token", errors: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of the rows whose image is found, written to ``out`` in a folder per shard, and the job's totals.

    ``rows`` has ``shard`` and ``image_path``; ``files`` has ``shard, file, content``, each file once. A shard that ``out``
    holds already is not done again. The model runs where the contents lie; only vectors are joined.

    A content that the model raises on costs its own rows only: they count as failed and go with the error's
    text to ``errors``, a folder per shard, if one is given. A shard of which nothing could be written is tried again by the next run.
    """
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(out).select("shard").distinct()
        rows = rows.join(sent_if_small(done), "shard", "left_anti")
    except AnalysisException:
        pass
    with scratch_tables(spark):
        seen, kept = Observation(), Observation()
        matched = _matched(rows, files, seen)
        found = matched.filter(F.col("path_status") == "ok")
        wanted = written(found.select("shard", F.col("matched_path").alias("file")).distinct(), "wanted")
        contents = files.join(sent_if_small(wanted), ["shard", "file"], "left_semi")
        made = attempted_vectors(contents, load, "content", batch_size=batch_size, pooling=pooling)
        vectors = written(made.select("shard", F.col("file").alias("matched_path"), "embedding", F.col("error").alias("_error")), "vectors")
        tried = found.join(vectors, ["shard", "matched_path"])
        full = tried.filter("_error is null").select(*rows.columns, "embedding")
        if {"dataset_id", "target_id", "patch_id"} <= set(rows.columns):
            full = ids.compose_ids(full)
        write_shards(full, out, "shard", "append", kept, F.count(F.lit(1)).alias("successful"))
        if errors is not None:
            lost = tried.filter("_error is not null").select(*rows.columns, F.col("_error").alias("error"))
            write_shards(lost, errors, "shard", "append")
        stats = _totals(spark, seen, kept.get["successful"])
    return spark.read.parquet(out), stats


def training_set(splits: DataFrame, difficulty: DataFrame, entity: str = "building_id",
                 item: str = "streetview_image_id", n: int | None = None, fraction: float | None = None,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of a sample of entities, and the difficulty rows of their items.

    Both tables are checked for their columns before any job starts.
    """
    require_columns(splits, [entity, item, "embedding", "split"], "split table")
    require_columns(difficulty, DIFFICULTY_COLUMNS, "difficulty table")
    rows = sample_entities(splits, entity, n, fraction, seed)
    keys = rows.select(F.col(item).alias("target_coord_hash")).distinct()
    return rows, keep_keys(difficulty, keys, "target_coord_hash")


def fingerprint_job(rows: DataFrame, files: DataFrame, decode: Decoder,
                    size: int = FINGERPRINT_SIZE) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows whose image is found, and the totals of the job.

    ``rows`` has ``shard`` and ``image_path``; ``files`` has ``shard, file, content``. Paths
    are matched on names only; fingerprints are made where the contents lie, so what is joined
    are 3 * size * size numbers.
    """
    seen = Observation()
    matched = _matched(rows, files, seen)
    found = matched.filter(F.col("path_status") == "ok")
    wanted = written(found.select("shard", F.col("matched_path").alias("file")).distinct(), "wanted")
    contents = files.join(sent_if_small(wanted), ["shard", "file"], "left_semi")
    made = pixel_fingerprint(contents, "content", size, decode).select(
        "shard", F.col("file").alias("matched_path"), "fingerprint", "decoded")
    out = found.join(made, ["shard", "matched_path"]).select(*rows.columns, "fingerprint", "decoded")
    if {"dataset_id", "target_id", "patch_id"} <= set(rows.columns):
        out = ids.compose_ids(out)
    return out, _totals(rows.sparkSession, seen, seen.get["found"])
