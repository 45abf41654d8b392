"""The pipeline against its stages done by hand, one after the other."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpora import SCHEMA, edges, empty, prose
from test_decontaminate import brute as brute_benchmark
from test_minhash import brute as brute_near, variants
from test_mixing import plain_targets
from test_streamdedup import lower


@pytest.fixture
def folder(spark, tmp_path):
    passage = prose(50, 30)
    texts = [prose(i, 40 + i) for i in range(20)] + variants(3, 12, 14)
    texts += [texts[0].upper(), texts[1], prose(60, 100) + " " + passage, passage, None, "12 34 !", "", prose(61, 900) + " " + passage]
    rows = [((i * 17) % 101, t, "en" if i % 2 else "fr", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, prose(70, 20))], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [r[:4] for r in rows], [(1, passage), (2, prose(70, 20))]


def by_hand(rows, items):
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = defaultdict(int)
    for r in kept:
        best[lower(r[1])] = max(best[lower(r[1])], r[0])
    kept = [r for r in kept if best[lower(r[1])] == r[0]]
    near = {r[0] for r in brute_near([r[:2] for r in kept]) if r[3]}
    kept = [r for r in kept if r[0] in near]
    bad = {r[0] for r in brute_benchmark([r[:2] for r in kept], items) if r[5]}
    return [r for r in kept if r[0] not in bad]


def test_equals_the_stages_by_hand(spark, folder):
    path, rows, items = folder
    kept = by_hand(rows, items)
    assert 5 < len(kept) < len(rows) - 10
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert got.keys() == {r[0] for r in kept}
    sizes = defaultdict(int)
    for r in kept:
        assert got[r[0]].size == len(r[1].split())
        sizes[r[3]] += got[r[0]].size
    want = plain_targets(sizes)
    for r in kept:
        assert got[r[0]].target == pytest.approx(want[r[3]]) and got[r[0]].taken <= 2 * got[r[0]].size


def test_stages_keep_the_columns_and_take_awkward_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for number, table in enumerate((edges(spark), empty(spark))):
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = str(tmp_path / f"t{number}-{place}")
            table.write.parquet(at)
            docs = spark.read.parquet(at)
            out = stage(spark, docs, path)
            if place < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.count() <= docs.count()


def test_awkward_rows_that_stay(spark, folder, tmp_path):
    path, _, _ = folder
    edges(spark).write.parquet(str(tmp_path / "edges"))
    docs = spark.read.parquet(str(tmp_path / "edges"))
    first = corpus_pipeline.known_language(spark, docs, path)
    assert sorted(str(r.doc_id) for r in first.collect()) == ["4", "5", "6", "6", "7", "8", "9", "None", "None"]
    second = corpus_pipeline.distinct_texts(spark, docs, path)
    # One row of each text: null, "" and None are one; of equal rows one stays.
    assert sorted(str(r.doc_id) for r in second.collect()) == ["2", "3", "5", "7", "8", "9", "None"]
    third = corpus_pipeline.distinct_wordings(spark, docs, path)
    assert sorted(str(r.doc_id) for r in third.collect()) == ["1", "2", "3", "4", "6", "6", "8", "9", "None", "None"]


def test_unlabelled_tables_are_judged_by_their_letters(spark, folder, tmp_path):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    first = corpus_pipeline.known_language(spark, docs, path)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}


def test_the_model_decides_what_stays(spark, folder, tmp_path):
    path, _, _ = folder
    english = ["the house of the king and the river " + prose(i, 3) for i in range(40)]
    french = ["la maison du roi et le fleuve des eaux " + prose(i, 3) for i in range(40)]
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(zip(english + french, ["en"] * 40 + ["fr"] * 40))]
    rows += [(100, "the king and the river", None, "s", 0), (101, "le roi et la maison", None, "s", 0), (102, "42 !", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)

    def kept(frame, **how):
        return {r.doc_id for r in corpus_pipeline.known_language(spark, frame, path, **how).collect()}
    assert kept(docs) == {r[0] for r in rows} - {102}
    assert kept(docs, wanted=["en"]) == set(range(40)) | {100}
    # The same texts under a model that learned the labels the other way round.
    other = docs.withColumn("lang", F.when(F.col("lang") == "en", "fr").when(F.col("lang") == "fr", "en"))
    assert kept(other, wanted=["en"]) == set(range(40, 80)) | {101}
    assert kept(docs, least_score=1.1) == set()
