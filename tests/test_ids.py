import pytest
from pyspark.sql import functions as F

from entityvec.functions import ids
from entityvec.operators import keysets
from entityvec.operators.ingest import match_paths

GOOD = "d 88 1234 567 890 45.5088 -73.5878 50.2 0.0 0.0 1.0 45.5090 -73.5880 2.0 150.5 45.0 10.0 0.0"


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.asDict() for r in ids.parse_metadata_line(df).orderBy("i").collect()]


def test_metadata_line(spark):
    rows = parse(
        spark, "head\n  " + GOOD, "no line", GOOD.rsplit(" ", 1)[0], GOOD.replace("88", "12.0", 1),
        "d 1 2\n" + GOOD, "\t" + GOOD + " \r\n", GOOD.replace("45.5088", "x"), None, "d\t1",
        GOOD.replace("d 88", "d +88"), GOOD.replace("-73.5878", "nan"), GOOD + " 5")
    assert [r["parsed"] for r in rows] == [
        True, False, False, False, False, True, False, False, False, True, True, False]
    assert rows[0] | {"i": 0, "text": 0} == {
        "i": 0, "text": 0, "parsed": True, "dataset_id": 88, "target_id": 1234, "patch_id": 567,
        "street_view_id": 890, "target_lat": 45.5088, "target_lon": -73.5878}
    assert rows[2]["target_id"] is None


def test_archive_name_overrides_line(spark):
    df = spark.createDataFrame([("0061.tar", GOOD)], "tar_file string, text string")
    row = ids.parse_metadata_line(df, "text", ids.shard_id(F.col("tar_file"))).first()
    assert (row.dataset_id, row.target_id) == (61, 1234)


def test_composed_ids(spark):
    df = spark.createDataFrame(
        [(88, 1234, 567), (12345, 1, 2), (-5, 1, 2), (None, 1, 2)],
        "dataset_id int, target_id bigint, patch_id bigint")
    rows = [(r.building_id, r.streetview_image_id) for r in ids.compose_ids(df).collect()]
    assert rows == [("0088_1234", "0088_567"), ("12345_1", "12345_2"), ("-005_1", "-005_2"),
                    (None, None)]
    with pytest.raises(ValueError, match="patch_id"):
        ids.compose_ids(df.drop("patch_id"))


def test_stored_ids_are_kept(spark):
    df = spark.createDataFrame([(1, 2, 3, "mine"), (1, 2, 3, None)],
                               "dataset_id int, target_id int, patch_id int, building_id string")
    assert [r.building_id for r in ids.compose_ids(df).collect()] == ["mine", "0001_2"]


def test_shard_id(spark):
    df = spark.createDataFrame([("/a/0061.parquet",), ("x.parquet",), ("12.tar",), ("a/b/7",)], "f string")
    assert [r[0] for r in df.select(ids.shard_id(F.col("f"))).collect()] == [61, None, 12, 7]


GAPS = "dataset_id string, building_id string, streetview_image_id string, image_path string, tar_file string"


def test_inferred_dataset_id(spark):
    rows = [("7", "8_1", None, None, None), ("x", "0008_1", "9_1", None, None),
            (None, None, "0009_1", "10/10/a", None), (None, "x_1", "y", "0010/0010/a.jpg", "11.tar"),
            (None, None, None, None, "0011.tar"), ("12.0", None, None, None, None)]
    df = spark.createDataFrame(rows, GAPS)
    assert [r.dataset_id for r in ids.infer_dataset_id(df).collect()] == [7, 8, 9, 10, 11, 12]
    bad = spark.createDataFrame([*rows, ("?", None, None, None, None)], GAPS)
    with pytest.raises(ValueError, match="cannot be inferred"):
        ids.infer_dataset_id(bad, on_missing="check")
    with pytest.raises(Exception, match="cannot be inferred"):
        ids.infer_dataset_id(bad).collect()
    assert ids.infer_dataset_id(bad, on_missing="null").filter("dataset_id is null").count() == 1


def test_strict_enrichment(spark):
    df = spark.createDataFrame([("0003_9", 1, 2)], "building_id string, target_id int, patch_id int")
    assert ids.enrich_identifiers(df).first().streetview_image_id == "0003_2"
    bad = spark.createDataFrame([("x_9", 1, 2)], df.schema)
    with pytest.raises(Exception, match="not numeric"):
        ids.enrich_identifiers(bad).collect()
    with pytest.raises(ValueError):
        ids.enrich_identifiers(df.drop("building_id"))


def test_schema_repair(spark):
    old = spark.createDataFrame(
        [(1.5, "0003_1338", "0003_5", "x")],
        "target_lat double, dataset_target_id string, dataset_patch_id string, dataset_target_patch_id string")
    fixed, changes = ids.repair_schema(old)
    assert fixed.columns == ["dataset_id", "building_id", "streetview_image_id", "target_lat"]
    assert fixed.first().dataset_id == 3 and [c.kind for c in changes] == ["rename", "rename", "drop", "infer"]
    again, none = ids.repair_schema(fixed)
    assert none == [] and again is fixed
    bad = spark.createDataFrame([("x_1",)], "dataset_target_id string")
    with pytest.raises(Exception, match="not numeric"):
        ids.repair_schema(bad)[0].collect()
    with pytest.raises(ValueError):
        ids.repair_schema(spark.createDataFrame([(1,)], "a int"))


def test_item_id(spark):
    df = spark.createDataFrame([("s", 1, 2, "h")],
                               "streetview_image_id string, dataset_id int, patch_id int, target_coord_hash string")
    drop = []
    for column, want in ((None, "s"), ("streetview_image_id", "0001_2"), ("patch_id", "h")):
        drop += [column] if column else []
        now = df.drop(*drop)
        assert now.select(ids.item_id(now)).first()[0] == want
    with pytest.raises(ValueError):
        ids.item_id(df.select("dataset_id"))


def test_paths(spark):
    df = spark.createDataFrame(
        [("0088/0088/a.jpg",), ("0088\\0088\\a.jpg",), (" ./x//y.jpg\n",), ("",), (".",), ("A/a/x.jpg",),
         ("/r/s",), ("one",), ("a/a",), (None,)], "p string")
    path = ids.normalize_path(F.col("p"))
    got = [tuple(r) for r in df.select(path, ids.drop_duplicate_segment(path)).collect()]
    assert got == [
        ("0088/0088/a.jpg", "0088/a.jpg"), ("0088/0088/a.jpg", "0088/a.jpg"), ("x/y.jpg", "x/y.jpg"),
        (None, None), (None, None), ("A/a/x.jpg", "A/x.jpg"), ("r/s", "r/s"), ("one", "one"),
        ("a/a", "a"), (None, None)]


def test_match_paths(spark):
    rows = spark.createDataFrame(
        [("s1", "1/1/a"), ("s1", "1/1/b"), ("s1", ""), ("s2", "2/2/a"), ("s2", "2/2/b"), ("s3", "3/3/a")],
        "shard string, image_path string")
    files = spark.createDataFrame(
        [("s1", "1/1/a"), ("s1", "1/b"), ("s2", "2/a")], "shard string, file string")
    got = {(r.shard, r.image_path): (r.matched_path, r.path_status)
           for r in match_paths(rows, files).collect()}
    # In s1 a plain path exists, so the shortened form is not tried there.
    assert got == {("s1", "1/1/a"): ("1/1/a", "ok"), ("s1", "1/1/b"): (None, "missing"),
                   ("s1", ""): (None, "invalid"), ("s2", "2/2/a"): ("2/a", "ok"),
                   ("s2", "2/2/b"): (None, "missing"), ("s3", "3/3/a"): (None, "missing")}


def test_exclusion_keeps_unknown_shards(spark):
    df = spark.createDataFrame([(4,), (5,), (None,)], "s int")
    assert [r.s for r in keysets.exclude_sources(df, F.col("s")).collect()] == [5, None]
