"""Pairing of metadata with images, path matching and job statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityvec.functions import ids
from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import written

# Accepted image suffixes, preferred first.
IMAGE_SUFFIXES = (".jpg", ".jpeg")


def pair_metadata_images(meta: DataFrame, images: DataFrame,
                         on: tuple[str, ...] = ("tar_file", "dir", "stem"),
                         parsed: str = "parsed", ok: str = "ok") -> DataFrame:
    """Metadata rows with ``ext`` and ``outcome``.

    Outcome is, in this order: ``orphan`` (metadata unusable), ``missing``, ``corrupt``,
    ``valid``. Images are reduced to the preferred suffix per stem before the join.
    """
    keys = list(on)
    rank = F.when(F.col("ext") == IMAGE_SUFFIXES[0], 0).otherwise(1)
    best = (images.filter(F.col("ext").isin(*IMAGE_SUFFIXES)).groupBy(*keys)
            .agg(F.min_by(F.struct("ext", F.col(ok).alias("ok")), rank).alias("_img")))
    outcome = (F.when(~F.coalesce(F.col(parsed), F.lit(False)), "orphan")
               .when(F.col("_img").isNull(), "missing")
               .when(~F.coalesce(F.col("_img.ok"), F.lit(False)), "corrupt")
               .otherwise("valid"))
    return (meta.join(best, keys, "left")
            .withColumn("ext", F.col("_img.ext")).withColumn("outcome", outcome)
            .drop("_img"))


def orphan_images(images: DataFrame, meta: DataFrame,
                  on: tuple[str, ...] = ("tar_file", "dir", "stem")) -> DataFrame:
    """Images without metadata."""
    return (images.filter(F.col("ext").isin(*IMAGE_SUFFIXES))
            .join(meta.select(*on), list(on), "left_anti"))


def intermediate_rows(paired: DataFrame) -> DataFrame:
    """The intermediate table: valid pairs with their ids and image path."""
    made = paired.filter(F.col("outcome") == "valid")
    made = ids.compose_ids(made)
    return made.withColumn(
        "image_path", ids.image_path(F.col("dataset_id"), F.col("stem"), F.col("ext"))
    ).select("dataset_id", "target_id", "patch_id", "street_view_id", "target_lat",
             "target_lon", "building_id", "streetview_image_id", "image_path", "tar_file")


# The names of the statistics below and in the job's totals.
def ingest_stats(outcomes: DataFrame, shard: str = "tar_file") -> DataFrame:
    """Exclusive outcome counts per archive."""
    o = F.col("outcome")
    return outcomes.groupBy(shard).agg(
        F.count(F.lit(1)).alias("total_metadata_files"),
        F.count_if(o == "valid").alias("valid_entries"),
        F.count_if(o != "valid").alias("invalid_entries"),
        F.count_if(o == "missing").alias("missing_images"),
        F.count_if(o == "corrupt").alias("corrupted_images"),
        F.count_if(o == "orphan").alias("orphan_metadata"))


def match_paths(rows: DataFrame, files: DataFrame, shard: str = "shard",
                path: str = "image_path", file: str = "file") -> DataFrame:
    """Find the file behind each row's path.

    A whole shard uses its paths as they are if any of them exists that way; otherwise
    with the doubled first segment removed if any exists that way; otherwise as they are.
    Each row then tries the shard's form first and the plain form second. Adds
    ``matched_path`` and ``path_status`` (``ok``, ``missing``, ``invalid``).
    """
    clean = ids.normalize_path(F.col(path))
    present = files.select(shard, F.col(file).alias("_file")).distinct()
    work = (rows.withColumn("_direct", clean)
            .withColumn("_short", ids.drop_duplicate_segment(F.col("_direct"))))
    direct = present.select(shard, F.col("_file").alias("_direct"), F.lit(True).alias("_has_d"))
    short = present.select(shard, F.col("_file").alias("_short"), F.lit(True).alias("_has_s"))
    # Shards with any plain path, from names alone; they go to the rows, which do not move by shard.
    votes = written(work.select(shard, "_direct").join(direct, [shard, "_direct"]).select(shard).distinct()
                    .withColumn("_any_d", F.lit(True)), "shard-votes")
    work = work.join(direct, [shard, "_direct"], "left")
    # A row falls back to its plain path anyway, and where no plain path of the shard exists
    # the fallback finds nothing; so the shard's choice only matters for the short form.
    work = work.join(short, [shard, "_short"], "left").join(sent_if_small(votes), shard, "left")
    matched = (F.when(F.col("_has_d"), F.col("_direct"))
               .when(~F.coalesce("_any_d", F.lit(False)) & F.coalesce("_has_s", F.lit(False)), F.col("_short")))
    status = (F.when(F.col("_direct").isNull(), "invalid").when(matched.isNull(), "missing")
              .otherwise("ok"))
    return (work.withColumn("matched_path", matched).withColumn("path_status", status)
            .select(*rows.columns, "matched_path", "path_status"))


def vector_job_stats(rows: DataFrame, done: str, status: str = "path_status") -> DataFrame:
    """Totals of a vector job; missing counts unusable paths too."""
    ok = F.count_if(F.coalesce(F.col(done), F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("total_entries"), ok.alias("successful"),
        (F.count(F.lit(1)) - ok).alias("failed"),
        F.count_if(F.col(status) != "ok").alias("missing"))
