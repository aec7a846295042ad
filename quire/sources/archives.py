"""Archives of any size: the members of zips and tars as a data source, read by seeking.

``spark.read.format("archive").load(path)`` has a row for each member. A zip's directory is read while the read is
planned (that of zip64 too), by seeking to its end; its members are dealt to partitions of about SLICE packed bytes.
A tar is a partition, followed from header to header past the data. A compressed tar can only be read from
its start, so it is one too, but no more than a member is held. Tars that lie in a zip are gone into.

Options: ``pattern``, a regular expression that a member's name must hold; ``content``: all (the default), none, or
stream: only where it passes anyway, in compressed tars. Rows without content can be joined with
what is wanted; fetched() then reads those members alone, by slices of the archives.

Files are opened by tasks through pyarrow, so the path must be one that it knows (local, hdfs, s3, gs, abfs).
A member is one value, so it has at most 2 GB. Members that can't be read have the reason in error.
"""

from __future__ import annotations

import fnmatch
import io
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLICE, CHUNK, ROWS = 32 << 20, 1 << 20, 10_000
#: How a member is stored: 0 and 8 are a zip's own numbers; bytes as they are; the n-th member of a stream.
STORED, DEFLATED, PLAIN, STREAM = 0, 8, 256, 257
MEMBERS = "path string, name string, inside string, at long, packed long, size long, method int, content binary, error string"
FIELDS = [c.split(" ")[0] for c in MEMBERS.split(", ")]
TAR = re.compile(r"\.(?:tar|tgz|tar\.\w+)$")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files(path: str) -> list[str]:
    """Files at a path: the file, those of a folder, or those that a pattern in the last part of the path names."""
    fs, at = opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    parent, _, last = at.rstrip("/").rpartition("/")
    if re.search(r"[*?\[]", last):
        found = [f for f in fs.get_file_info(pafs.FileSelector(parent)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        one = fs.get_file_info(at)
        found = fs.get_file_info(pafs.FileSelector(at)) if one.type == pafs.FileType.Directory else [one]
    if any(f.type == pafs.FileType.NotFound for f in found):
        raise FileNotFoundError(path)
    return sorted(scheme + f.path for f in found if f.type == pafs.FileType.File)


class Part(io.RawIOBase):
    """A stretch of an open file as a file of its own."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.place = file, start, size, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.place

    def seek(self, offset, whence=0):
        self.place = offset + (0, self.place, self.size)[whence]
        return self.place

    def readinto(self, buffer):
        self.file.seek(self.start + self.place)
        got = self.file.read(max(0, min(len(buffer), self.size - self.place)))
        buffer[: len(got)] = got
        self.place += len(got)
        return len(got)


class Inflated(io.RawIOBase):
    """What a stretch of an open file holds when it is inflated, as a stream."""

    def __init__(self, part: Part):
        self.part, self.engine, self.rest = part, zlib.decompressobj(-15), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self.rest and not self.engine.eof:
            raw = self.engine.unconsumed_tail or self.part.read(CHUNK)
            if not raw:
                break
            self.rest = self.engine.decompress(raw, CHUNK)
        got, self.rest = self.rest[: len(buffer)], self.rest[len(buffer) :]
        buffer[: len(got)] = got
        return len(got)


def data_start(file, header: int) -> int:
    """Where a zip member's data begins, past its own header."""
    file.seek(header)
    raw = file.read(30)
    if raw[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {header}")
    name, extra = struct.unpack("<HH", raw[26:30])
    return header + 30 + name + extra


def member_bytes(file, m: dict) -> bytes:
    """A member that can be reached by seeking."""
    if m["method"] == PLAIN:
        file.seek(m["at"])
        return file.read(m["size"])
    if m["method"] not in (STORED, DEFLATED):
        raise NotImplementedError(f"compression {m['method']}")
    part = Part(file, data_start(file, m["at"]), m["packed"])
    data = (Inflated(part) if m["method"] == DEFLATED else part).read()
    if len(data) != m["size"]:
        raise zipfile.BadZipFile(f"{len(data)} bytes of {m['size']}")
    return data


def tar_members(path: str, file, start: int, size: int, inside: str | None) -> Iterator[dict]:
    """Members of a plain tar that is a stretch of a file, from header to header."""
    with tarfile.open(fileobj=io.BufferedReader(Part(file, start, size), 512), mode="r:") as tar:
        while m := tar.next():
            tar.members = []  # else it keeps them all
            if m.isfile():
                yield {"path": path, "name": m.name, "inside": inside, "at": start + m.offset_data, "packed": m.size, "size": m.size, "method": PLAIN}


def stream_members(path: str, stream, inside: str | None, wanted=lambda k, name: False) -> Iterator[dict]:
    """Members of a tar that is read from its start; those of a wanted place and name with their content."""
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for k, m in enumerate(tar):
            tar.members = []
            if m.isfile():
                content = tar.extractfile(m).read() if wanted(k, m.name) else None
                yield {"path": path, "name": m.name, "inside": inside, "at": k, "packed": m.size, "size": m.size, "method": STREAM, "content": content}


def is_plain_tar(file, start: int) -> bool:
    file.seek(start + 257)
    return file.read(5) == b"ustar"


def inner_stream(file, m: dict):
    part = Part(file, data_start(file, m["at"]), m["packed"])
    return io.BufferedReader(Inflated(part) if m["method"] == DEFLATED else part, CHUNK)


def zip_members(path: str, file) -> Iterator[dict]:
    """Members of a zip as its directory tells."""
    with zipfile.ZipFile(file) as z:
        for i in z.infolist():
            if not i.is_dir():
                error = "encrypted" if i.flag_bits & 1 else None
                yield {"path": path, "name": i.filename, "at": i.header_offset, "packed": i.compress_size, "size": i.file_size, "method": i.compress_type, "error": error}


class Slice(InputPartition):
    """A zip's members that lie together, a tar, or a tar in a zip (its member)."""

    def __init__(self, path: str, members: list[dict] | None = None, inner: dict | None = None):
        self.path, self.members, self.inner = path, members, inner


def slices(path: str, pattern: re.Pattern) -> Iterator[Slice]:
    fs, at = opened(path)
    with fs.open_input_file(at) as file:
        if not zipfile.is_zipfile(file):
            yield Slice(path)
            return
        held, size = [], 0
        for m in zip_members(path, file):
            if TAR.search(m["name"]) and not m["error"]:
                yield Slice(path, inner=m)
            elif pattern.search(m["name"]):
                if held and (size + m["packed"] > SLICE or len(held) == ROWS):
                    yield Slice(path, held)
                    held, size = [], 0
                held.append(m)
                size += m["packed"]
        if held:
            yield Slice(path, held)


def sliced(part: Slice, pattern: re.Pattern, content: str) -> Iterator[dict]:
    """The rows of a partition."""
    wanted = (lambda k, name: pattern.search(name)) if content != "none" else (lambda k, name: False)
    if part.members is not None and (content != "all" or not part.members):
        yield from part.members
        return
    fs, at = opened(part.path)
    with fs.open_input_file(at) as file:
        if part.members is not None:
            yield from (with_content(file, m) for m in part.members)
            return
        inner, inside = part.inner, part.inner and part.inner["name"]
        start, size = (data_start(file, inner["at"]), inner["packed"]) if inner else (0, file.size())
        if (not inner or inner["method"] == STORED) and is_plain_tar(file, start):
            found = tar_members(part.path, file, start, size, inside)
            found = (m if content != "all" or not pattern.search(m["name"]) else with_content(file, m) for m in found)
        else:
            stream = inner_stream(file, inner) if inner else fs.open_input_stream(at, compression=None)
            found = stream_members(part.path, stream, inside, wanted)
        yield from (m for m in found if pattern.search(m["name"]))


def with_content(file, m: dict) -> dict:
    if m.get("error"):
        return m
    try:
        return m | {"content": member_bytes(file, m)}
    except (zipfile.BadZipFile, zlib.error, NotImplementedError) as e:
        return m | {"error": f"{type(e).__name__}: {e}"[:200]}


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.content = options["path"], options.get("content", "all")
        self.pattern = re.compile(options.get("pattern", ""))

    def partitions(self):
        # A read without partitions would be planned as one of an unknown partition.
        return [s for path in files(self.paths) for s in slices(path, self.pattern)] or [Slice("", [])]

    def read(self, partition):
        for m in sliced(partition, self.pattern, self.content):
            yield tuple(m.get(c) for c in FIELDS)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return ArchiveReader(dict(self.options))


def members(spark: SparkSession, path: str, pattern: str = "", content: str = "none") -> DataFrame:
    """The members of archives whose names hold the pattern; columns MEMBERS."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("pattern", pattern).option("content", content).load(path)


def fetched(listed: DataFrame) -> DataFrame:
    """Listed members (columns MEMBERS, and others) with their content; only they are inflated.

    Members that lie within one slice of an archive are read by one task, in their order; those of a
    compressed tar by one task for each tar, since it has to be read from its start.
    """
    where = F.when(F.col("method") == STREAM, -1).otherwise(F.floor(F.col("at") / SLICE))
    dealt = listed.withColumn("content", F.col("content").cast("binary")).repartition("path", "inside", where).sortWithinPartitions("path", "inside", "at")
    columns = listed.columns

    def run(frames):
        rows = (r for frame in frames for r in frame.to_dict("records"))
        held, size = [], 0
        for (path, inside), group in groupby(rows, lambda r: (r["path"], r["inside"])):
            for m in read(path, inside, group):
                held.append(m)
                size += len(m["content"] or b"")
                if size > CHUNK or len(held) == 1000:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    def read(path, inside, group):
        fs, at = opened(path)
        with fs.open_input_file(at) as file:
            for by_stream, part in groupby(group, lambda m: m["method"] == STREAM):
                if not by_stream:
                    yield from (with_content(file, m) for m in part)
                    continue
                part = list(part)  # facts of members, without content
                wanted: dict = {}
                for m in part:
                    wanted.setdefault(m["at"], []).append(m)
                stream = fs.open_input_stream(at, compression=None)
                if inside:
                    stream = inner_stream(file, next(m for m in zip_members(path, file) if m["name"] == inside))
                for m in stream_members(path, stream, inside, lambda k, name: k in wanted):  # noqa: B023
                    yield from (w | {"content": m["content"]} for w in wanted.get(m["at"], ()))

    return dealt.mapInPandas(run, dealt.schema)


def write_zips(entries: DataFrame, path: str) -> int:
    """Write entries (name, content) as zips in a folder, one by each task; how many entries they hold.

    A task writes beside its zip and renames it at the end, so one that runs again leaves one zip of the same name.
    """

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = opened(path)
        fs.create_dir(at)
        target, n = f"{at}/part-{context.partitionId():05d}.zip", 0
        beside = f"{at}/.{context.taskAttemptId()}"
        with fs.open_output_stream(beside) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for batch in batches:
                for name, content in zip(*batch.columns, strict=True):  # a member at a time becomes a Python value
                    z.writestr(name.as_py(), content.as_py() or b"")
                    n += 1
        fs.move(beside, target) if n else fs.delete_file(beside)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return entries.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
