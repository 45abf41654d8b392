"""Corpus pipeline: each stage is an operator whose decisions take effect on all that is left.

Stages take (spark, docs, sf_dir) and return the columns of ``docs``, the last one the mix.
Each result is a written table, so a lost executor repeats part of one stage at most.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityvec.functions.joins import sent_if_small
from entityvec.functions.scratch import scratch_dir, written
from entityvec.llm.decontaminate import contaminated
from entityvec.llm.langid import UNKNOWN, held_out, identify, train
from entityvec.llm.minhash import near_duplicates
from entityvec.llm.mixing import pareto_mix
from entityvec.llm.streamdedup import exact_duplicates


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


#: Least posterior probability of a text's language, and the languages that are wanted (None: all that were learned).
LEAST_SCORE, WANTED = 0.5, None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: list[str] | None = WANTED,
                   least_score: float = LEAST_SCORE) -> DataFrame:
    """Keeps texts that the model finds to be of a wanted language with a score of ``least_score`` or more.

    Null, empty and blank texts and those without a letter are rejected, others of any length are judged whole. A null
    doc_id or lang does not matter, repeated rows are judged alike, ties of two languages go to the first by name. Without
    any row to learn from there is no model, and every text with a letter is kept. Extra columns are passed on under
    their names, an empty table stays empty.
    """
    model = train(docs.filter(~held_out()))
    if not model.langs:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    label, score = _unused(docs, "lang_pred"), _unused(docs, "score")
    named = identify(docs, model, docs.columns, label, score)
    chosen = F.col(label) != UNKNOWN if wanted is None else F.col(label).isin(wanted)
    return named.filter(chosen & (F.col(score) >= least_score)).drop(label, score)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts.

    Null and empty are the same text; a row without doc_id stays only if no other has its text, and of rows that share the
    largest doc_id the last one by file and row. Texts are digested whole, however long. Extra columns are passed on under
    their names, an empty table stays empty.
    """
    path = f"{scratch_dir(spark).rstrip('/')}/entityvec/landed-{spark.sql('SELECT uuid()').first()[0]}"
    docs.write.parquet(path)
    # The landed files lie in one folder, so their base names tell them apart.
    file, row = _unused(docs, "_file"), _unused(docs, "_row")
    dropped = written(exact_duplicates(spark, path).filter("not kept").select(
        F.substring_index("file", "/", -1).alias(file), F.col("row").alias(row)), "copies")
    landed = spark.read.parquet(path)
    at = landed.metadataColumn("_metadata")
    landed = landed.select("*", at["file_name"].alias(file), at["row_index"].alias(row))
    return landed.join(sent_if_small(dropped), [file, row], "left_anti").drop(file, row)


def distinct_wordings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates.

    Null, empty and blank texts and rows without doc_id are in no group and stay. Rows of one doc_id are one document and
    stay or go together. Texts are compared whole, however long. Extra columns are passed on under their names, an
    empty table stays empty.
    """
    dropped = written(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(sent_if_small(dropped), "doc_id", "left_anti").select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated with benchmark passages.

    Null and empty texts have no words and stay; texts are read whole, however long. Repeated rows, also without doc_id, are judged
    each by their own text. Extra columns are passed on under their names, an empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    doc, key = _unused(docs, "_doc"), _unused(docs, "_key")
    dropped = written(contaminated(docs, items, text_key=True).filter("contaminated")
                      .select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(sent_if_small(dropped), same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the mix, a row for each document.

    A null source is one of its own and the last in order, a null text has size 0. Whole texts are counted, however long; repeated
    rows are drawn each, ties by doc_id. Extra columns are not read, an empty table gives no rows.
    """
    return pareto_mix(docs)


STAGES = [
    ("language identification", known_language),
    ("exact deduplication", distinct_texts),
    ("near deduplication", distinct_wordings),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing", mixed),
]

#: The language model and the near-duplicate groups of what it leaves are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{place + 1}")
    return docs
