"""Members of tar and zip archives, indexed without their contents and read by place.

An archive's directory (a zip's own, a tar's chain of headers) is listed by a data source
with one partition per archive. The listing is an ordinary table, so it is filtered and
joined like one; only then are the bytes of the members that are left read, each from its
place in its archive, by as many tasks as the bytes ask for. Archives are opened through
Arrow's file systems and never held as a whole.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docmine.functions.text import file_stem
from docmine.session import materialise

INDEX = "archive string, member string, place long, packed long, size long, method int, crc long"
#: Bytes of members that one task reads.
TASK_BYTES = 128 << 20
#: Tar members have no method or checksum of their own.
PLAIN = -1


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _IndexReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[InputPartition]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_Archive(f.path) for f in files if f.is_file and f.path.lower().endswith((".tar", ".zip"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        keep = lambda name: name.lower().endswith(self.suffix)
        with system.open_input_file(partition.value) as f:
            if partition.value.lower().endswith(".zip"):
                with zipfile.ZipFile(f) as box:
                    for m in box.infolist():
                        if not m.is_dir() and keep(m.filename):
                            yield partition.value, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC
            else:
                with tarfile.open(fileobj=f, mode="r:") as box:
                    while (m := box.next()) is not None:
                        # The list that the module keeps would grow with the archive.
                        box.members = []
                        if m.isfile() and keep(m.name):
                            yield partition.value, m.name, m.offset_data, m.size, m.size, PLAIN, None


class ArchiveIndex(DataSource):
    """``archive_index``: one row per member of the archives under a path; option ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options["path"], self.options.get("suffix", ""))


def archive_index(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, place, packed, size, method, crc, stem) of the members under a path
    that are files and end in ``suffix``, in any case. Contents are not read."""
    spark.dataSource.register(ArchiveIndex)
    listed = spark.read.format("archive_index").option("suffix", suffix.lower()).load(path)
    return listed.withColumn("stem", file_stem(F.col("member")))


def _content(f, place: int, packed: int, method: int, crc: int | None) -> bytes:
    f.seek(place)
    if method == PLAIN:
        return f.read(packed)
    head = f.read(30)
    flags, name, extra = struct.unpack("<H", head[6:8])[0], *struct.unpack("<HH", head[26:30])
    if head[:4] != b"PK\x03\x04" or flags & 1 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"member at {place} is not a plain stored or deflated one")
    f.seek(place + 30 + name + extra)
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    if zlib.crc32(data) != crc:
        raise ValueError(f"member at {place} does not match its checksum")
    return data


def member_contents(index: DataFrame, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, member, stem, content) of the listed members. They are dealt by archive and
    place, about ``task_bytes`` to a task, so a large archive is read by many tasks, each
    going forward through its own part. ``index`` is evaluated once and stored."""
    listed = materialise(index.select("archive", "member", "stem", "place", "packed", "method", "crc"), "archive-index")
    total = listed.agg(F.sum("packed")).first()[0] or 0
    dealt = listed.repartitionByRange(max(1, -(-total // task_bytes)), "archive", "place").sortWithinPartitions("archive", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(path)
        name, f = None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["archive"] != name:
                        if f is not None:
                            f.close()
                        name, f = row["archive"], system.open_input_file(row["archive"])
                    content = _content(f, row["place"], row["packed"], row["method"], row["crc"])
                    yield pa.RecordBatch.from_pylist([{"archive": name, "member": row["member"], "stem": row["stem"], "content": content}], schema=out)
        finally:
            if f is not None:
                f.close()

    out = pa.schema([("archive", pa.string()), ("member", pa.string()), ("stem", pa.string()), ("content", pa.binary())])
    return dealt.mapInArrow(run, "archive string, member string, stem string, content binary")


def read_archive_members(
    spark: SparkSession, path: str, suffix: str, keys: DataFrame | None = None, key: str = "stem"
) -> DataFrame:
    """(archive, member, stem, content) of members with the suffix in any case and, with a
    key table, one of its keys as stem. Bytes of other members are not read."""
    wanted = archive_index(spark, path, suffix)
    if keys is not None:
        wanted = wanted.join(keys.select(F.col(key).alias("stem")).distinct(), "stem", "left_semi")
    return member_contents(wanted, path)


def write_archives(members: DataFrame, path: str) -> DataFrame:
    """Write rows (archive, member, content) as archives under a path; a name that ends in
    ``.zip`` is a zip, every other a tar. Returns (archive, n_members).

    An archive is written by one task, member by member, under a name of that task, and
    renamed when it is whole, so a task that is run again replaces what it wrote."""
    sorted_rows = members.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _opened(path)
        system.create_dir(root, recursive=True)
        mine = f"{root}/.{TaskContext.get().taskAttemptId()}.part"
        name, box, stream, done = None, None, None, []

        def close():
            if box is not None:
                box.close()
                stream.close()
                system.move(mine, f"{root}/{name}")

        count = 0
        for batch in batches:
            for archive, member, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "content")), strict=True):
                if archive != name:
                    close()
                    if name is not None:
                        done.append((name, count))
                    name, count, stream = archive, 0, system.open_output_stream(mine)
                    box = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) if name.endswith(".zip") else tarfile.open(fileobj=stream, mode="w|")
                if isinstance(box, zipfile.ZipFile):
                    box.writestr(member, content)
                else:
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    box.addfile(info, io.BytesIO(content))
                    box.members = []
                count += 1
        close()
        if name is not None:
            done.append((name, count))
        yield pa.RecordBatch.from_pydict({"archive": pa.array([d[0] for d in done], pa.string()), "n_members": pa.array([d[1] for d in done], pa.int64())})

    return materialise(sorted_rows.mapInArrow(run, "archive string, n_members long"), "archives-written")
