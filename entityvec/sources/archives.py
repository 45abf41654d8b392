"""Tar archives: list the members first, then read them in parallel by offset.

Only headers are read for the listing of a plain archive (a reader seeks over the contents), so a
single large one does not have to be unpacked or read by one task. A compressed archive has no
offsets to seek to: one task streams it. Paths must be reachable through the file system
of every executor; object stores need a mount.
"""

import glob
import lzma
import math
import os
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from entityvec.functions.scratch import written

MEMBERS = ("path string, tar_file string, dir string, stem string, ext string, "
           "offset bigint, size bigint, packed boolean")
MEMBER_COLUMNS = ["path", "tar_file", "dir", "stem", "ext", "offset", "size", "packed"]
TARGET_BYTES = 64 * 1024 * 1024
MAX_TASKS = 100_000
#: Tasks that archives are listed by, more only on a cluster with more cores than an eighth of it; rows of a batch.
LISTING_TASKS, BATCH_ROWS = 512, 10_000


def _split_name(name: str) -> tuple[str, str, str]:
    folder, _, base = name.rpartition("/")
    stem, dot, ext = base.rpartition(".")
    return (folder, stem, "." + ext) if dot and stem else (folder, base, "")


# First bytes of the compressed formats that tar archives come in.
PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00")


def _is_packed(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(6).startswith(PACKED)


def _members(path: str) -> list[tuple]:
    """The files of one archive; none if it cannot be read to its end."""
    rows = []
    try:
        packed = _is_packed(path)
        with tarfile.open(path, "r:*") as tar:
            for m in tar:
                if m.isfile():
                    rows.append((path, path.rpartition("/")[2], *_split_name(m.name), m.offset_data, m.size, packed))
    except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError):
        return []
    return rows


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = []
    for batch in batches:
        for path in batch["path"]:
            held += _members(path)
            if len(held) >= BATCH_ROWS:
                for i in range(0, len(held), BATCH_ROWS):
                    yield pd.DataFrame(held[i:i + BATCH_ROWS], columns=MEMBER_COLUMNS)
                held = []
    if held:
        yield pd.DataFrame(held, columns=MEMBER_COLUMNS)


def list_archive_members(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """One row per file in the archives, of any compression; none for an archive that is damaged."""
    names = spark.createDataFrame([(p,) for p in paths], "path string")
    tasks = min(max(1, names.count()), max(LISTING_TASKS, 8 * spark.sparkContext.defaultParallelism))
    return names.repartition(tasks).mapInPandas(_list, MEMBERS)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        for path, part in batch.sort_values(["path", "offset"]).groupby("path", sort=False):
            for row, content in (_streamed if part["packed"].iloc[0] else _sought)(path, part):
                held.append((row.tar_file, row.dir, row.stem, row.ext, content))
                size += row.size
                if size >= TARGET_BYTES or len(held) >= BATCH_ROWS:
                    yield _frame(held)
                    held, size = [], 0
    if held:
        yield _frame(held)


def _sought(path: str, part: pd.DataFrame):
    with open(path, "rb") as f:
        for row in part.itertuples(index=False):
            f.seek(row.offset)
            yield row, f.read(row.size)


def _streamed(path: str, part: pd.DataFrame):
    wanted = {row.offset: row for row in part.itertuples(index=False)}
    with tarfile.open(path, "r|*") as tar:
        for m in tar:
            if m.offset_data in wanted:
                yield wanted[m.offset_data], tar.extractfile(m).read()


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["tar_file", "dir", "stem", "ext", "content"])


def read_members(members: DataFrame) -> DataFrame:
    """``tar_file, dir, stem, ext, content`` of listed members.

    Members are grouped by (archive, 64 MB range) so that reads stay sequential; those of a
    compressed archive stay together. The number of tasks follows the bytes behind the
    members, which a shuffle cannot see.
    """
    total = members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = min(max(math.ceil(total / TARGET_BYTES), members.sparkSession.sparkContext.defaultParallelism),
                MAX_TASKS)
    part = F.when(F.col("packed"), F.lit(0)).otherwise(F.floor(F.col("offset") / TARGET_BYTES))
    return (members.repartition(tasks, "path", part)
            .mapInPandas(_read, "tar_file string, dir string, stem string, ext string, content binary"))


def read_archives(spark: SparkSession, paths: Iterable[str],
                  suffixes: Iterable[str] | None = None) -> DataFrame:
    """``tar_file, dir, stem, ext, content`` of the members, optionally of some suffixes."""
    members = list_archive_members(spark, paths)
    if suffixes is not None:
        members = members.filter(F.col("ext").isin(list(suffixes)))
    return read_members(written(members, "members"))


def texts_of(contents: DataFrame) -> DataFrame:
    """``tar_file, dir, stem, text``; null where the content is not UTF-8."""
    text = F.col("content").cast("string")
    return contents.select("tar_file", "dir", "stem", F.when(F.is_valid_utf8(text), text).alias("text"))


def metadata_texts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``tar_file, dir, stem, text`` of the text members."""
    return texts_of(read_archives(spark, paths, [".txt"]))


CONTENTS = "tar_file string, dir string, stem string, ext string, content binary"
#: Columns whose filters are answered from the headers, without reading contents.
_NAMED = ("tar_file", "dir", "stem", "ext")


#: Partitions that small ranges are dealt over; more only if they are larger than ``TARGET_BYTES`` otherwise.
PARTITIONS = 512


class Ranges(InputPartition):
    """Members of archives whose contents start in (path, start, end) ranges of bytes."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        self.ranges = ranges
        self.start, self.end = (ranges[0][1], ranges[-1][2]) if ranges else (0, None)


def _dealt(ranges: list[tuple[str, int, int | None]], sizes: list[int]) -> list[Ranges]:
    """Neighbouring ranges together, so that partitions are neither very many nor very large."""
    least = min(TARGET_BYTES, math.ceil(sum(sizes) / PARTITIONS))
    out, held, room = [], [], least
    for (path, start, end), size in zip(ranges, sizes):
        if held and room < size:
            out.append(Ranges(held))
            held, room = [], least
        if held and held[-1][0] == path:
            # One walk over the headers of an archive.
            held[-1] = (path, held[-1][1], end)
        else:
            held.append((path, start, end))
        room -= size
    return [*out, Ranges(held)]


class ArchiveReader(DataSourceReader):
    """Reads ranges of archives; filters on the names of members are taken over from the query."""

    def __init__(self, paths: list[str], range_bytes: int):
        self.paths, self.range_bytes, self.allowed = paths, range_bytes, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _NAMED:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.allowed[f.attribute[0]] = self.allowed.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        ranges, sizes = [], []
        for path in self.paths:
            if path.rpartition("/")[2] not in self.allowed.get("tar_file", {path.rpartition("/")[2]}):
                continue
            try:
                packed, size = _is_packed(path), os.path.getsize(path)
            except OSError:
                continue
            # A compressed archive has no offsets to seek to.
            step = size + 1 if packed else self.range_bytes
            for a in range(0, size + 1, step):
                ranges.append((path, a, None if a + step > size else a + step))
                sizes.append(min(step, size - a))
        return _dealt(ranges, sizes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.ranges:
            yield from self._read_range(path, start, end)

    def _read_range(self, path: str, start: int, end: int | None) -> Iterator[pa.RecordBatch]:
        members = pd.DataFrame(_members(path), columns=MEMBER_COLUMNS)
        members = members[(members["offset"] >= start) & (members["offset"] < (math.inf if end is None else end))]
        for column, values in self.allowed.items():
            members = members[members[column].isin(values)]
        if len(members):
            for frame in _read(iter([members])):
                yield from pa.Table.from_pandas(frame, pa.schema([*[(n, pa.string()) for n in _NAMED], ("content", pa.binary())]),
                                                preserve_index=False).to_batches()


class Archives(DataSource):
    """Members of tar archives as a table: ``spark.read.format("tar_members").load("/folder/*.tar")``.

    The path is a pattern; every task of the cluster must reach the files under the same name. Partitions are byte
    ranges of option ``range_bytes`` (64 MB), small ones dealt together; each walks over the headers of its archives, as a tar has no index, and reads the
    contents in its ranges. An
    archive that cannot be read to its end gives nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return CONTENTS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(sorted(glob.glob(self.options["path"])), int(self.options.get("range_bytes", TARGET_BYTES)))


def register_archives(spark: SparkSession) -> None:
    """Make format ``tar_members`` known to the session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
