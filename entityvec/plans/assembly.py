"""Split assembly: ids, singleton filter, exact split, clean-up, report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityvec.functions.ids import compose_ids, enrich_identifiers
from entityvec.functions.joins import sent_if_small
from entityvec.functions.schema import HELPER_COLUMNS, require_columns
from entityvec.functions.scratch import scratch_tables, written
from entityvec.operators.entities import entity_counts
from entityvec.operators.splits import split_of


def entity_split(df: DataFrame, entity: str = "building_id", seed: int = 42,
                 train: float = 0.7, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Rows of entities with at least two rows, with ``split``; no entity is in two splits.

    The wide rows are read once. The entity table is written from one scan of the id columns and gives
    the cut points and the singletons; the split is an expression of the id, so the only join is the
    singleton filter.
    """
    if entity == "building_id" and entity not in df.columns:
        require_columns(df, ["dataset_id", "target_id", "patch_id"], "split input")
        df = compose_ids(df)
    counts = written(entity_counts(df, entity), "entities")
    split = split_of(counts.filter("n > 1").select(entity), entity, seed, train, val, test)
    single = sent_if_small(counts.filter("n = 1").select(entity))
    rows = df.join(single, entity, "left_anti")
    kept = [c for c in df.columns if c not in HELPER_COLUMNS]
    return rows.select(*kept, split.alias("split"))


def assemble(df: DataFrame, path: str, seed: int = 42, train: float = 0.7, val: float = 0.15,
             test: float = 0.15) -> None:
    """Strict ids, split, write: one folder per split."""
    with scratch_tables(df.sparkSession):
        rows = entity_split(enrich_identifiers(df), "building_id", seed, train, val, test)
        rows.write.partitionBy("split").parquet(path)


def unmatched_entities(rows: DataFrame, split_map: DataFrame, entity: str) -> DataFrame:
    """Entities that a given split map does not know (they would fall into ``test``)."""
    return rows.select(entity).filter(F.col(entity).isNotNull()).distinct().join(
        split_map.select(entity), entity, "left_anti")
