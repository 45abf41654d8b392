import bz2
import gzip
import io
import lzma
import shutil
import os
import sys
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from entityvec.operators import images, ingest
from entityvec.plans.assembly import assemble
from entityvec.plans import ingest as ingest_jobs
from entityvec.plans.difficulty import fingerprint_difficulty, write_difficulty
from entityvec.plans.ingest import (
    archive_outcomes, embedding_job, fingerprint_job, ingest_archives, training_set)
from entityvec.sources import archives, tables

# The functions below run in tasks, which do not see this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE = "d 1 {t} {p} 9 45.5 -73.5 50.2 0.0 0.0 1.0 45.5 -73.5 2.0 150.5 45.0 10.0 0.0\n"


def decode(data: bytes) -> np.ndarray:
    """Stand-in codec: two size bytes, then RGB."""
    h, w = data[0], data[1]
    return np.frombuffer(data[2:], np.uint8).reshape(h, w, 3)


def encode(h, w, value):
    return bytes([h, w]) + bytes([value]) * (h * w * 3)


@pytest.fixture
def archive(tmp_path):
    def add(tar, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    path = tmp_path / "0061.tar"
    with tarfile.open(path, "w") as tar:
        for i, ext in enumerate([".jpg", ".jpeg"]):
            add(tar, f"61/x/ok{i}.txt", LINE.format(t=i, p=10 + i).encode())
            add(tar, f"61/x/ok{i}{ext}", encode(2, 2, 7))
        add(tar, "61/x/both.txt", LINE.format(t=5, p=15).encode())
        add(tar, "61/x/both.jpg", b"bad")
        add(tar, "61/x/both.jpeg", encode(2, 2, 7))
        add(tar, "61/x/lone.txt", LINE.format(t=6, p=16).encode())
        add(tar, "61/y/lone.jpg", encode(2, 2, 7))
        add(tar, "61/x/upper.txt", LINE.format(t=7, p=17).encode())
        add(tar, "61/x/upper.JPG", encode(2, 2, 7))
        add(tar, "61/x/dot.v1.txt", LINE.format(t=8, p=18).encode())
        add(tar, "61/x/dot.v1.jpg", encode(2, 2, 7))
        add(tar, "61/x/none.txt", b"x 1 2\n")
    (tmp_path / "0062.tar").write_bytes(b"not a tar at all" * 100)
    cut = path.read_bytes()
    (tmp_path / "0063.tar").write_bytes(cut[:3000])
    (tmp_path / "notes.tar").write_bytes(cut)
    return [str(tmp_path / n) for n in ("0061.tar", "0062.tar", "0063.tar", "notes.tar")]


def test_members_and_contents(spark, archive):
    listed = archives.list_archive_members(spark, archive[:1])
    assert listed.count() == 14
    got = {(r.dir, r.stem, r.ext): bytes(r.content) for r in archives.read_archives(spark, archive[:2]).collect()}
    assert len(got) == 14
    assert got[("61/x", "dot.v1", ".jpg")] == encode(2, 2, 7)
    assert got[("61/x", "none", ".txt")] == b"x 1 2\n"
    assert archives.read_archives(spark, archive[1:2]).count() == 0


def test_outcomes(spark, archive):
    out = archive_outcomes(spark, archive, decode)
    got = {r.stem: (r.outcome, r.ext) for r in out.filter("tar_file = '0061.tar'").collect()}
    assert got == {"ok0": ("valid", ".jpg"), "ok1": ("valid", ".jpeg"), "both": ("corrupt", ".jpg"),
                   "lone": ("missing", None), "upper": ("missing", None), "dot.v1": ("valid", ".jpg"),
                   "none": ("orphan", None)}
    assert {r.tar_file for r in out.collect()} == {"0061.tar"}
    stats = ingest.ingest_stats(out).first()
    assert tuple(stats) == ("0061.tar", 7, 3, 4, 2, 1, 1)
    rows = {r.image_path: r for r in ingest.intermediate_rows(out).collect()}
    assert set(rows) == {"0061/0061/ok0.jpg", "0061/0061/ok1.jpeg", "0061/0061/dot.v1.jpg"}
    assert rows["0061/0061/ok0.jpg"].building_id == "0061_0"
    assert rows["0061/0061/ok1.jpeg"].streetview_image_id == "0061_11"


def test_compressed_archives(spark, archive, tmp_path):
    plain = archives.read_archives(spark, archive[:1]).collect()
    raw = open(archive[0], "rb").read()
    for name, pack in (("0071.tar", gzip.compress), ("0072.tar.bz2", bz2.compress), ("0073.tar.xz", lzma.compress)):
        path = tmp_path / name
        path.write_bytes(pack(raw))
        got = archives.read_archives(spark, [str(path)]).collect()
        assert sorted((r.dir, r.stem, r.ext, bytes(r.content)) for r in got) == sorted(
            (r.dir, r.stem, r.ext, bytes(r.content)) for r in plain)
    (tmp_path / "0074.tar").write_bytes(gzip.compress(raw)[:300])
    assert archives.read_archives(spark, [str(tmp_path / "0074.tar")]).count() == 0


def test_text_that_is_not_utf8_is_an_orphan(spark, tmp_path):
    path = tmp_path / "0061.tar"
    with tarfile.open(path, "w") as tar:
        for name, data in (("a.txt", b"\xe9 no"), ("b.txt", LINE.format(t=1, p=2).encode()), ("b.jpg", encode(2, 2, 7))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = {r.stem: r.outcome for r in archive_outcomes(spark, [str(path)], decode).collect()}
    assert got == {"a": "orphan", "b": "valid"}


def test_archives_to_intermediate_rows(spark, archive, tmp_path):
    out = str(tmp_path / "intermediate")
    stats = {r.tar_file: tuple(r)[1:] for r in ingest_archives(spark, archive, out, decode).collect()}
    zero = (0, 0, 0, 0, 0, 0, False)
    assert stats == {"0061.tar": (7, 3, 4, 2, 1, 1, True), "0062.tar": zero, "0063.tar": zero, "notes.tar": zero}
    assert {(r.dataset_id, r.image_path) for r in spark.read.parquet(out).collect()} == {
        (61, "0061/0061/ok0.jpg"), (61, "0061/0061/ok1.jpeg"), (61, "0061/0061/dot.v1.jpg")}


def test_embedding_job_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.jpg"), (1, "none.jpg"), (2, "1/x/b.jpg"), (2, "c.jpg")], "shard int, image_path string")
    files = spark.createDataFrame([(1, "a.jpg", b"12"), (2, "x/b.jpg", b"1"), (2, "c.jpg", b"123"), (2, "d.jpg", b"")],
                                  "shard int, file string, content binary")
    out = str(tmp_path / "vectors")

    def load():
        return lambda payloads: np.array([[len(p)] for p in payloads], np.float32)

    def go(part):
        made, stats = embedding_job(part, files, load, out)
        return {(r.shard, r.image_path): list(r.embedding) for r in made.collect()}, tuple(stats.first())

    made, stats = go(rows.filter("shard = 1"))
    assert made == {(1, "a.jpg"): [2.0]} and stats == (2, 1, 1, 1)
    made, stats = go(rows)
    assert made[(1, "a.jpg")] == [2.0] and made[(2, "c.jpg")] == [3.0] and stats[0] == 2
    assert len(made) == len(set(made)) and go(rows)[1][0] == 0


def test_a_bad_payload_costs_its_own_row(spark, tmp_path):
    rows = spark.createDataFrame([(s, f"{i}.jpg") for s in (1, 2, 3) for i in range(4)], "shard int, image_path string")
    files = spark.createDataFrame([(s, f"{i}.jpg", bytes(10 * s + i) if (s, i) != (3, 3) else None) for s in (1, 2, 3) for i in range(4)
                                   if (s, i) != (1, 0)], "shard int, file string, content binary")

    def load():
        def model(payloads):
            if any(len(p) in (21, 30, 31, 32) for p in payloads):
                raise ValueError("cannot be read")
            return np.array([[len(p)] for p in payloads], np.float32)
        return model
    out, bad = str(tmp_path / "vectors"), str(tmp_path / "errors")
    made, stats = embedding_job(rows, files, load, out, batch_size=3, errors=bad)
    assert sorted((r.shard, r.image_path) for r in made.collect()) == [
        (1, "1.jpg"), (1, "2.jpg"), (1, "3.jpg"), (2, "0.jpg"), (2, "2.jpg"), (2, "3.jpg")]
    assert tuple(stats.first()) == (12, 6, 6, 1)
    errors = {(r.shard, r.image_path): r.error for r in spark.read.parquet(bad).collect()}
    assert errors.keys() == {(2, "1.jpg"), (3, "0.jpg"), (3, "1.jpg"), (3, "2.jpg"), (3, "3.jpg")}
    assert errors[(2, "1.jpg")] == "ValueError: cannot be read"
    # The shard without any vector is tried again.
    made, stats = embedding_job(rows, files, lambda: lambda p: np.ones((len(p), 1), np.float32), out)
    assert tuple(stats.first()) == (4, 4, 0, 0) and made.filter("shard = 3").count() == 4


def test_footers_of_many_files_by_one_job(spark, tmp_path):
    for i in range(2000):
        kind = pa.string() if i % 3 else pa.int64()
        ids = pa.array([str(i)] if i % 3 else [i], kind)
        pq.write_table(pa.table({"streetview_image_id": ids, "building_id": ids, "fingerprint": pa.array([[i % 256]], pa.list_(pa.int64()))}),
                       tmp_path / f"{i:04d}.parquet")
    for name in ("x1.parquet", "x2.parquet"):
        (tmp_path / name).write_bytes(b"PAR1 not a footer")
    group = "footers"
    spark.sparkContext.setJobGroup(group, group)
    skipped: list[str] = []
    got = tables.read_fingerprints(spark, str(tmp_path), skipped)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20 and [f.rpartition("/")[2] for f in skipped] == ["x1.parquet", "x2.parquet"]
    assert got.count() == 2000 and got.agg(F.sum(F.col("building_id").cast("int"))).first()[0] == sum(range(2000))
    read = tables.read_parquet_dir(spark, str(tmp_path), ["building_id"], "0*.parquet", types={"building_id": "string"})
    assert sorted(r.building_id for r in read.collect()) == sorted(str(i) for i in range(1000))
    with pytest.raises(ValueError, match="x1"):
        tables.read_parquet_dir(spark, str(tmp_path), types={"building_id": "string"})


def test_training_set(spark):
    splits = spark.createDataFrame([(f"b{i // 2}", f"i{i}", [1.0], "train") for i in range(20)],
                                   "building_id string, streetview_image_id string, embedding array<float>, split string")
    difficulty = spark.createDataFrame([(f"i{i}", ["x"], [1.0], [0]) for i in range(0, 30, 3)],
                                       "target_coord_hash string, neighbor_building_ids array<string>, "
                                       "neighbor_distances_meters array<double>, neighbor_bands array<int>")
    rows, near = training_set(splits, difficulty, n=4)
    items = {r.streetview_image_id for r in rows.collect()}
    assert len(items) == 8
    assert {r.target_coord_hash for r in near.collect()} == {f"i{i}" for i in range(0, 30, 3)} & items
    with pytest.raises(ValueError, match="embedding"):
        training_set(splits.drop("embedding"), difficulty)


def test_fingerprints_with_mixed_id_types(spark, tmp_path):
    path = tmp_path / "fp"
    path.mkdir()
    for kind in ("string", "bigint"):
        (spark.range(4).selectExpr(f"cast(id as {kind}) streetview_image_id", f"cast(id as {kind}) building_id",
                                   "array(cast(1 as int)) fingerprint")
         .coalesce(1).write.parquet(str(tmp_path / kind)))
        for f in (tmp_path / kind).glob("*.parquet"):
            shutil.copy(f, path / f"{kind}.parquet")
    (path / "bad.parquet").write_bytes(b"nothing of the kind")
    skipped = []
    got = tables.read_fingerprints(spark, str(path), skipped)
    assert got.count() == 8 and {r.streetview_image_id for r in got.collect()} == {"0", "1", "2", "3"}
    assert [s.rpartition("/")[2] for s in skipped] == ["bad.parquet"]
    with pytest.warns(UserWarning, match="bad.parquet"):
        tables.read_fingerprints(spark, str(path))


def test_orphan_images(spark):
    meta = spark.createDataFrame([("t", "d", "a")], "tar_file string, dir string, stem string")
    imgs = spark.createDataFrame([("t", "d", "a", ".jpg"), ("t", "e", "a", ".jpeg"), ("t", "d", "b", ".png")],
                                 "tar_file string, dir string, stem string, ext string")
    assert [(r.dir, r.stem) for r in ingest.orphan_images(imgs, meta).collect()] == [("e", "a")]


def test_markers(spark):
    df = spark.createDataFrame([(b"\xff\xd8ab\xff\xd9",), (b"\xff\xd8\xff",), (b"",), (None,), (b"\xff\xd8abcd",)],
                               "content binary")
    got = images.validate_images(df).collect()
    assert [r.ok for r in got] == [True, False, False, False, False]
    assert {r.check for r in got} == {"markers"}


def test_image_source(spark, tmp_path):
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    df = spark.read.format("image").load(str(tmp_path)).select("image")
    row = images.pixel_fingerprint(df, "image").first()
    assert row.fingerprint == [0] * 768 and not row.decoded


def test_stored_pixels_are_turned_to_rgb(spark):
    data = bytearray([1, 2, 3] * 4)
    df = spark.createDataFrame([((2, 2, 3, data),), ((-1, -1, -1, bytearray()),), ((1, 1, 1, bytearray([9])),)],
                               "image struct<height:int,width:int,nChannels:int,data:binary>")
    got = images.pixel_fingerprint(df, "image", 2).collect()
    assert got[0].fingerprint == [3, 2, 1] * 4 and got[0].decoded
    assert got[1].fingerprint == [0] * 12 and not got[1].decoded
    assert got[2].fingerprint == [9] * 12


def test_resize():
    assert (images.resize_bilinear(np.full((40, 30, 3), 77, np.uint8), 16) == 77).all()
    # Halving: each output pixel weighs four source pixels 1:3:3:1, less at the edges.
    row = np.array([0, 0, 80, 160], np.uint8)
    img = np.repeat(np.repeat(row[None, :, None], 4, 0), 3, 2)
    got = images.resize_bilinear(img, 2)[0, :, 0]
    assert list(got) == [round((0 * 3 + 0 * 3 + 80) / 7), round((0 + 80 * 3 + 160 * 3) / 7)]
    # Doubling two pixels: quarter steps between the centres.
    two = np.array([[[0] * 3, [100] * 3]] * 2, np.uint8)
    assert list(images.resize_bilinear(two, 4)[0, :, 0]) == [0, 25, 75, 100]
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (50, 37, 3)).astype(np.uint8)
    w, h = (images.resize_weights(n, 16) / (1 << 22) for n in (37, 50))
    smooth = np.einsum("ai,ijc,bj->abc", h, img.astype(float), w)
    assert np.abs(images.resize_bilinear(img, 16) - smooth).max() <= 1.01


def test_fingerprint_job(spark):
    rows = spark.createDataFrame(
        [("1", "1/1/a.jpg", 1, 2, 3), ("1", "1/1/b.jpg", 1, 2, 4), ("1", "", 1, 2, 5), ("1", "1/1/c.jpg", 1, 2, 6)],
        "shard string, image_path string, dataset_id int, target_id int, patch_id int")
    files = spark.createDataFrame([("1", "1/a.jpg", encode(3, 3, 5)), ("1", "1/b.jpg", b"??")],
                                  "shard string, file string, content binary")
    out, stats = fingerprint_job(rows, files, decode, 2)
    got = {r.streetview_image_id: (r.fingerprint, r.decoded) for r in out.collect()}
    assert got == {"0001_3": ([5] * 12, True), "0001_4": ([0] * 12, False)}
    assert tuple(stats.first()) == (4, 2, 2, 2)


def test_fingerprints_to_difficulty(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", f"b{i % 9}", [int(x) for x in rng.integers(0, 256, 48)]) for i in range(60)]
    spark.createDataFrame(rows, "streetview_image_id string, building_id string, fingerprint array<bigint>") \
        .repartition(3).write.parquet(str(tmp_path / "fp"))
    (tmp_path / "fp" / "broken.parquet").write_bytes(b"PAR1 no")
    fp = tables.read_fingerprints(spark, str(tmp_path / "fp"))
    assert fp.count() == 60
    made = fingerprint_difficulty(fp, components=8, k=10, k0=3)
    write_difficulty(made, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    facts = back.schema["target_coord_hash"].metadata
    assert facts["neighbors"] == "10" and facts["pca_components"] == "8"
    entity = {r[0]: r[1] for r in rows}
    for r in back.collect():
        d = r.neighbor_distances_meters
        assert len(d) == 10 and d == sorted(d)
        assert entity[r.target_coord_hash] not in r.neighbor_building_ids
        assert r.neighbor_bands == sorted(r.neighbor_bands) and set(r.neighbor_bands) <= set(range(7))


def test_read_parquet_dir(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_parquet_dir(spark, str(tmp_path))
    spark.range(3).withColumn("x", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="y"):
        tables.read_parquet_dir(spark, str(tmp_path / "t"), required=["y"])
    with pytest.raises(ValueError):
        tables.read_parquet_dir(spark, str(tmp_path / "t"), pattern="*_embeddings.parquet")
    df = tables.read_parquet_dir(spark, str(tmp_path / "t"), ["x"], file_name="f")
    assert df.columns == ["x", "f"] and df.first().f.endswith(".parquet")
    empty = tmp_path / "none"
    os.mkdir(empty)
    with pytest.raises(ValueError):
        tables.read_fingerprints(spark, str(empty))


def test_payload_without_key_or_flag(spark):
    df = spark.createDataFrame([(b"a",), (b"",), (None,)], "image_bytes binary")
    assert [(r.OSMID, bytes(r.image_bytes)) for r in tables.usable_payloads(df).collect()] == [(None, b"a")]
    flagged = df.withColumn("is_valid", F.lit(False))
    assert tables.usable_payloads(flagged).count() == 0
    assert tables.usable_payloads(flagged, filter_valid=False).count() == 1


def test_writers(spark, tmp_path):
    df = spark.range(40).select(
        (F.col("id") % 2).alias("dataset_id"), (F.col("id") % 10).alias("target_id"),
        F.col("id").alias("patch_id"), F.lit("t").alias("tar_file"))
    tables.write_shards(df, str(tmp_path / "shards"))
    assert sorted(p for p in os.listdir(tmp_path / "shards") if "=" in p) == ["dataset_id=0", "dataset_id=1"]
    assemble(df, str(tmp_path / "splits"))
    back = spark.read.parquet(str(tmp_path / "splits"))
    assert back.count() == 40 and "tar_file" not in back.columns
    tables.write_splits(back.withColumn("image_path", F.lit("p")), str(tmp_path / "again"))
    assert "image_path" not in spark.read.parquet(str(tmp_path / "again")).columns


def test_archives_as_a_data_source(spark, tmp_path):
    for n in range(3):
        with tarfile.open(tmp_path / f"{n:04d}.tar", "w:gz" if n == 1 else "w") as tar:
            for i in range(40):
                for ext, data in ((".txt", b"t%d" % i), (".jpg", bytes(300 + i))):
                    info = tarfile.TarInfo(f"d/{i}{ext}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    whole = (tmp_path / "0000.tar").read_bytes()
    (tmp_path / "0003.tar").write_bytes(whole[:200])
    archives.register_archives(spark)
    made = spark.read.format("tar_members").option("range_bytes", 5000).load(f"{tmp_path}/*.tar")
    want = archives.read_archives(spark, [str(p) for p in sorted(tmp_path.glob("*.tar"))])
    rows = sorted(map(tuple, made.collect()))
    assert rows == sorted(map(tuple, want.select(made.columns).collect())) and len(rows) == 240
    # Several ranges of the plain archives, one task for the compressed one.
    assert made.rdd.getNumPartitions() > 10
    some = made.filter("ext = '.txt' and tar_file in ('0000.tar', '0001.tar') and stem > '2'")
    assert sorted((r.tar_file, r.stem, bytes(r.content)) for r in some.collect()) == sorted(
        (f"000{n}.tar", str(i), b"t%d" % i) for n in (0, 1) for i in range(40) if str(i) > "2")


def test_filters_on_names_are_answered_from_headers(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    reader = archives.ArchiveReader([str(tmp_path / "a.tar"), str(tmp_path / "b.tar")], 10)
    (tmp_path / "a.tar").write_bytes(b"x" * 25)
    other = GreaterThan(("stem",), "1")
    assert list(reader.pushFilters([EqualTo(("ext",), ".txt"), other, In(("tar_file",), ("a.tar", "c.tar"))])) == [other]
    assert reader.allowed == {"ext": {".txt"}, "tar_file": {"a.tar", "c.tar"}}
    assert [(p.start, p.end) for p in reader.partitions()] == [(0, 10), (10, 20), (20, None)]


def test_archives_of_one_name_are_refused(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "0001.tar").write_bytes(b"")
    with pytest.raises(ValueError, match="one name"):
        archive_outcomes(spark, [str(tmp_path / f / "0001.tar") for f in ("x", "y")])


def test_job_totals_come_from_the_writing_passes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.jpg"), (1, "none.jpg"), (2, "b.jpg")], "shard int, image_path string")
    files = spark.createDataFrame([(1, "a.jpg", b"12"), (2, "b.jpg", b"1")], "shard int, file string, content binary")
    made, stats = embedding_job(rows, files, lambda: lambda p: np.ones((len(p), 1), np.float32), str(tmp_path / "v"))
    # Totals are values that were counted on the way: no scan, no shuffle, no aggregate.
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert tuple(stats.first()) == (3, 2, 1, 1) and "Aggregate" not in plan and "FileScan" not in plan


def test_small_ranges_of_many_archives_share_partitions(tmp_path):
    from entityvec.sources import archives
    for i in range(1500):
        with tarfile.open(tmp_path / f"{i:04d}.tar", "w") as tar:
            info = tarfile.TarInfo(f"x/s{i}.txt")
            info.size = 2
            tar.addfile(info, io.BytesIO(b"ab"))
    reader = archives.ArchiveReader(sorted(map(str, tmp_path.glob("*.tar"))), 5000)
    parts = reader.partitions()
    assert len(parts) <= 2 * archives.PARTITIONS
    stems = [x for p in parts for batch in reader.read(p) for x in batch.column("stem").to_pylist()]
    assert sorted(stems) == sorted(f"s{i}" for i in range(1500))


def test_many_archives_are_listed_and_written_by_few_tasks(spark, tmp_path):
    names = [f"/none/{i}.tar" for i in range(2000)]
    assert archives.list_archive_members(spark, names).rdd.getNumPartitions() <= 512
    even = spark.range(1000).selectExpr("id || '.tar' AS tar_file", "20L AS valid_entries")
    writers = ingest_jobs._even_tasks(spark, even)
    assert writers == 4 * spark.sparkContext.defaultParallelism
    hot = even.withColumn("valid_entries", F.when(F.col("tar_file") == "7.tar", 10_000).otherwise(20))
    assert ingest_jobs._even_tasks(spark, hot) is None and ingest_jobs._even_tasks(spark, even.limit(20)) is None
    assert ingest_jobs._even_tasks(spark, even.limit(0)) is None
    rows = spark.range(3000).selectExpr("id % 300 AS dataset_id", "id")
    tables.write_shards(rows, str(tmp_path / "out"), tasks=writers)
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == 300
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(3000))


def test_fingerprints_are_made_in_slices(spark):
    sizes = [len(x) for x in images._slices(iter([pd.Series(range(1300)), pd.Series([], dtype=object), pd.Series([1])]))]
    assert sum(sizes) == 1301 and max(sizes) <= images.SLICE_ROWS and len(sizes) == 5
    rows = spark.range(0, 1300, 1, 1).select("id", F.col("id").cast("string").cast("binary").alias("content"))
    made = images.pixel_fingerprint(rows, "content", 2, lambda b: np.full((3, 3, 3), int(b) % 251, np.uint8))
    assert {(r["id"], *set(r["fingerprint"])) for r in made.collect()} == {(i, i % 251) for i in range(1300)}


def test_many_small_image_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"p{i}.png").write_bytes(b"%d" % i)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        files = tables.read_image_files(spark, str(tmp_path), decoded=False)
        assert files.rdd.getNumPartitions() <= tables.READING_TASKS
        assert sorted(int(r["content"]) for r in files.select("content").collect()) == list(range(600))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
