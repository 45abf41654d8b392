"""Counts, filters and reports per entity."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions import ids
from entityvec.functions.joins import sent_if_small
from entityvec.functions.schema import require_columns
from entityvec.functions.scratch import written
from entityvec.functions.vectors import l2_normalize, norm


def entity_counts(df: DataFrame, entity: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))


def singletons(df: DataFrame, entity: str) -> DataFrame:
    return entity_counts(df, entity).filter("n = 1").select(entity)


def drop_singletons(df: DataFrame, entity: str) -> DataFrame:
    """Rows of entities that have at least two rows.

    Only the ids are aggregated; rows meet the singleton ids in an anti join, so a hot
    entity is never gathered in one task. Few singletons go to the rows, which then stay where they are.
    """
    single = written(singletons(df, entity), "singletons")
    return df.join(sent_if_small(single), entity, "left_anti").select(df.columns)


def singleton_report(df: DataFrame, entity: str) -> DataFrame:
    """Rows and entities before and after :func:`drop_singletons`, and the share removed."""
    return (entity_counts(df, entity).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("entities_before"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_after"),
        F.count_if(F.col("n") > 1).alias("entities_after"),
    ).withColumn("removed_percent", F.when(
        F.col("rows_before") > 0,
        (F.col("rows_before") - F.col("rows_after")) * 100.0 / F.col("rows_before"),
    ).otherwise(0.0)))


def valid_entities(df: DataFrame, entity: str) -> DataFrame:
    """Entities that can give an anchor and a positive, with their item count."""
    return entity_counts(df, entity).filter("n > 1")


def epoch_length(df: DataFrame, entity: str) -> int:
    total = valid_entities(df, entity).agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no entity has two items, so no triplet can be formed")
    return int(total)


def sampling_stats(df: DataFrame, entity: str) -> DataFrame:
    return entity_counts(df, entity).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("entities"),
        (F.sum("n") / F.count(F.lit(1))).alias("rows_per_entity"))


def distinct_id_summary(df: DataFrame, shard: Column | None = None) -> DataFrame:
    """Distinct datasets, targets, patches, entities and images.

    Pairs of numbers are made distinct first; what is left is counted, and composed into
    text only where a stored id column has to be merged in.
    """
    df = ids.with_known_spellings(df)
    if "dataset_id" in df.columns:
        dataset = _number(df, "dataset_id")
    elif shard is not None:
        dataset = ids.shard_id(shard)
    else:
        dataset = ids.shard_id(F.col("_metadata.file_name"))
    counted = []
    for part, composed in (("target_id", "building_id"), ("patch_id", "streetview_image_id")):
        pairs = df.select(dataset.alias("dataset_id"), _number(df, part).alias(part)).distinct()
        both = F.when(F.col("dataset_id").isNotNull() & F.col(part).isNotNull(), 1)
        found = [F.count_distinct(part).alias(part)]
        if part == "target_id":
            found.append(F.count_distinct("dataset_id").alias("dataset_id"))
        if composed in df.columns:
            names = (pairs.select(ids.composite_id(F.col("dataset_id"), F.col(part)).alias("id"))
                     .unionByName(df.select(F.col(composed).cast("string").alias("id")).distinct())
                     .filter(F.col("id").isNotNull()).distinct())
            counted.append(names.agg(F.count(F.lit(1)).alias(composed)))
        else:
            found.append(F.count(both).alias(composed))
        counted.append(pairs.agg(*found))
    return _one_row(counted, ["dataset_id", "target_id", "patch_id", "building_id",
                              "streetview_image_id"])


def _one_row(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """One-row frames with different columns side by side, without a join."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def _number(df: DataFrame, column: str) -> Column:
    """Whole number of a column; no text round trip where it is one already."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return F.col(column).cast("bigint")
    return ids.to_whole_number(F.col(column))


def split_report(rows: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """Rows and entities per split, and in total (split ``all``)."""
    per_entity = rows.groupBy(split, entity).agg(F.count(F.lit(1)).alias("n"))
    return (per_entity.rollup(split)
            .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("entities"))
            .select(F.coalesce(split, F.lit("all")).alias("split"), "rows", "entities"))


def assembly_stats(source: DataFrame, kept: DataFrame, entity: str,
                   file_name: str | None = None) -> DataFrame:
    """Rows read, rows kept, entities kept, rows per split; files when a name is given."""
    require_columns(kept, [entity, "split"], "split rows")
    files = F.count_distinct(file_name) if file_name else F.lit(None).cast("bigint")
    read = source.agg(F.count(F.lit(1)).alias("rows_read"), files.alias("files"))
    per_entity = kept.groupBy(entity, "split").agg(F.count(F.lit(1)).alias("n"))
    names = [f"{s}_rows" for s in ("train", "val", "test")]
    out = per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_kept"),
        F.count(F.lit(1)).alias("entities_kept"),
        *[F.coalesce(F.sum(F.when(F.col("split") == n[:-5], F.col("n"))), F.lit(0)).alias(n)
          for n in names])
    return _one_row([read, out], ["rows_read", "files", "rows_kept", "entities_kept", *names])


def split_leakage(rows: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """Entities found in more than one split; must be empty."""
    return (rows.groupBy(entity, split).agg(F.lit(1).alias("_x"))
            .groupBy(entity).agg(F.count(F.lit(1)).alias("splits")).filter("splits > 1"))


def mean_pool(df: DataFrame, entity: str, vector: str) -> DataFrame:
    """Unit vector of the mean item vector of each entity.

    The mean is combined before the shuffle, so one partial vector per entity and task
    moves, not the items.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    pooled = df.groupBy(entity).agg(mean.alias("_m"), F.count(F.lit(1)).alias("items"))
    pooled = pooled.withColumn("_m", vector_to_array("_m"))
    return pooled.select(entity, "items", l2_normalize(F.col("_m")).alias(vector))


def norm_report(df: DataFrame, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """Lengths of vectors that should be unit vectors."""
    return df.select(norm(F.col(vector)).alias("l")).agg(
        F.count(F.lit(1)).alias("vectors"), F.avg("l").alias("mean_norm"),
        F.min("l").alias("min_norm"), F.max("l").alias("max_norm"),
        F.count_if(F.abs(F.col("l") - 1.0) > tolerance).alias("off_unit"))
