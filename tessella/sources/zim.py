"""ZIM archives of articles as a Spark source and sink, by the public layout of the format.

An archive has a header, a list of media types, pointers to directory entries in the order of their paths, and clusters that
hold the contents, compressed with zstd or plain. Reading takes two steps, each parted: the directory, by ranges of entries
of bounded size, and the contents, by clusters: each cluster that a row needs is read once, whatever the order of paths.
Only the first step runs where contents are not asked for. Archives may lie wherever pyarrow's file systems reach.

    entries(spark, path)                 # (archive, namespace, path, title, mime, redirect, cluster, blob)
    contents(entries(spark, path))       # with `content`
    spark.read.format("zim").option("path", path).load()
    save(rows, folder)                   # one archive a partition

Contents of xz clusters are not read (no decoder here): they fail with the cluster's number. Redirects have no content.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC, HEADER, REDIRECT, NOTHING = 72173914, "<IHH16sIIQQQQIIQ", 0xFFFF, 0xFFFFFFFF
PLAIN, XZ, ZSTD, EXTENDED = 1, 4, 5, 0x10
#: Entries of one partition; bytes of one cluster that is written; clusters that a task keeps.
RANGE, CLUSTER_BYTES, KEPT = 20_000, 1 << 20, 8
#: Bytes of the contents of one archive that is written.
ARCHIVE_BYTES = 64 << 20
ENTRY = "archive string, namespace string, path string, title string, mime string, redirect string, cluster long, blob long"


@dataclass
class Header:
    entries: int
    clusters: int
    paths_at: int
    clusters_at: int
    media_at: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the name there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str) -> pa.NativeFile:
    system, name = _located(path)
    return system.open_input_file(name)


def _read(file: pa.NativeFile, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def header(file: pa.NativeFile) -> Header:
    raw = _read(file, 0, struct.calcsize(HEADER))
    if len(raw) < struct.calcsize(HEADER) or struct.unpack_from("<I", raw)[0] != MAGIC:
        raise ValueError("no ZIM archive")
    _, _, _, _, entries, clusters, paths_at, _, clusters_at, media_at, _, _, _ = struct.unpack(HEADER, raw)
    return Header(entries, clusters, paths_at, clusters_at, media_at)


def _media_types(file: pa.NativeFile, at: int) -> list[str]:
    raw = b""
    while b"\0\0" not in raw and not raw.startswith(b"\0"):
        more = _read(file, at + len(raw), 4096)
        if not more:
            break
        raw += more
    return [] if raw.startswith(b"\0") else raw.split(b"\0\0", 1)[0].decode().split("\0")


def _entry(file: pa.NativeFile, at: int) -> tuple[int, str, int, int, str, str]:
    """Media type, namespace, cluster (or target of a redirect), blob, path and title of the entry at a place."""
    size = 512
    while True:
        raw = _read(file, at, size)
        kind, extra, space = struct.unpack_from("<HBc", raw)
        fixed = 12 if kind == REDIRECT else 16
        parts = raw[fixed:].split(b"\0", 2)
        if len(parts) == 3:
            break
        if len(raw) < size:
            raise ValueError(f"the directory entry at {at} has no end")
        size *= 4
    where, blob = struct.unpack_from("<I", raw, 8)[0], 0 if kind == REDIRECT else struct.unpack_from("<I", raw, 12)[0]
    path, title = parts[0].decode(), parts[1].decode()
    return kind, space.decode("latin-1"), where, blob, path, title or path


def read_entries(path: str, first: int, last: int) -> Iterator[tuple]:
    """The directory entries from first to before last, as rows of ENTRY."""
    with _open(path) as file:
        head = header(file)
        media, pointers = _media_types(file, head.media_at), struct.unpack(f"<{last - first}Q", _read(file, head.paths_at + 8 * first, 8 * (last - first)))
        for at in pointers:
            kind, space, where, blob, name, title = _entry(file, at)
            if kind == REDIRECT:
                target = struct.unpack("<Q", _read(file, head.paths_at + 8 * where, 8))[0]
                yield path, space, name, title, None, _entry(file, target)[4], None, None
            else:
                yield path, space, name, title, media[kind] if kind < len(media) else None, None, where, blob


class _Shared:
    """A file that stays open when a stream over it is closed."""

    closed = False

    def __init__(self, file: pa.NativeFile) -> None:
        self.read = file.read

    def close(self) -> None:
        pass


class Cluster:
    """The contents of one cluster."""

    def __init__(self, file: pa.NativeFile, head: Header, number: int) -> None:
        at = struct.unpack("<Q", _read(file, head.clusters_at + 8 * number, 8))[0]
        kind = _read(file, at, 1)[0]
        file.seek(at + 1)
        if kind & 0x0F == ZSTD:
            # a cluster's length is not stored: the stream ends by itself
            stream = pa.CompressedInputStream(pa.PythonFile(_Shared(file), "r"), "zstd")
            read = stream.read
        elif kind & 0x0F in (0, PLAIN):
            read = file.read
        else:
            raise ValueError(f"cluster {number} is compressed in a way that is not read here ({kind & 0x0F})")
        width, sign = (8, "Q") if kind & EXTENDED else (4, "I")
        start = read(width)
        count = struct.unpack(f"<{sign}", start)[0] // width
        self.offsets = struct.unpack(f"<{count}{sign}", start + _exactly(read, width * (count - 1)))
        self.data = _exactly(read, self.offsets[-1] - self.offsets[0])

    def blob(self, number: int) -> bytes:
        return self.data[self.offsets[number] - self.offsets[0] : self.offsets[number + 1] - self.offsets[0]]


def _exactly(read, size: int) -> bytes:
    parts, left = [], size
    while left:
        part = read(left)
        if not part:
            raise ValueError("the archive is cut off")
        parts.append(bytes(part))
        left -= len(part)
    return b"".join(parts)


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class ZimReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        out = []
        for path in archives(self.path):
            with _open(path) as file:
                n = header(file).entries
            out += [Range(path, a, min(n, a + self.size)) for a in range(0, n, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.last > partition.first:
            yield from read_entries(partition.path, partition.first, partition.last)


class ZimDataSource(DataSource):
    """Directory entries of one archive or of all archives in a folder; option entries: how many a partition has at most."""

    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ZimReader:
        return ZimReader(self.options["path"], int(self.options.get("entries", RANGE)))


def archives(path: str) -> list[str]:
    """The archives that a path names: a file, or those of a folder in order of their names."""
    system, name = _located(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.extension == "zim")
    return [f"{path.rstrip('/')}/{n}" for n in names]


def entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    spark.dataSource.register(ZimDataSource)
    return spark.read.format("zim").option("path", path).option("entries", size).load()


def contents(rows: DataFrame) -> DataFrame:
    """rows of entries() with their `content`; rows without a cluster have none. Other columns stay."""
    kinds = rows.withColumn("content", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, tuple[pa.NativeFile, Header]] = {}
        known: OrderedDict[tuple[str, int], Cluster] = OrderedDict()
        for batch in batches:
            out = []
            for archive, number, blob in zip(*(batch.column(c).to_pylist() for c in ("archive", "cluster", "blob")), strict=True):
                if archive not in files:
                    file = _open(archive)
                    files[archive] = file, header(file)
                if (archive, number) not in known:
                    known[archive, number] = Cluster(*files[archive], number)
                    if len(known) > KEPT:
                        known.popitem(last=False)
                out.append(known[archive, number].blob(blob))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "content"])
        for file, _ in files.values():
            file.close()

    held = rows.where("cluster IS NOT NULL").repartition("archive", "cluster").sortWithinPartitions("archive", "cluster", "blob")
    return held.mapInArrow(run, kinds).unionByName(rows.where("cluster IS NULL").withColumn("content", F.lit(None).cast("binary")))


def save(rows: DataFrame, folder: str) -> None:
    """Write (path, title, mime, content) as archives of at most about ARCHIVE_BYTES of contents, each put together in its task.

    A task that is run again writes the same names again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, written = [], 0, 0
        system, name = _located(folder)
        part = TaskContext.get().partitionId()

        def write() -> None:
            with system.open_output_stream(f"{name}/part-{part:05d}-{written:05d}.zim") as out:
                out.write(packed(held))

        for batch in batches:
            for path, title, mime, content in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                held.append(("C", path, title, mime, None, content))
                size += len(content or b"")
                if size > ARCHIVE_BYTES:
                    write()
                    held, size, written = [], 0, written + 1
        if held:
            write()
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    system, name = _located(folder)
    system.create_dir(name)
    rows.select("path", "title", "mime", "content").mapInArrow(run, "written long").write.format("noop").mode("overwrite").save()


def packed(rows: list[tuple[str, str, str, str, str | None, bytes | None]]) -> bytes:
    """An archive of rows (namespace, path, title, mime, redirect, content); a redirect names a path of the same namespace."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].encode()))
    media = sorted({r[3] or "" for r in rows if r[4] is None})
    place = {(r[0], r[1]): i for i, r in enumerate(rows)}
    clusters: list[list[bytes]] = [[]]
    where, size = {}, 0
    for i, r in enumerate(rows):
        if r[4] is None:
            if size > CLUSTER_BYTES:
                clusters.append([])
                size = 0
            where[i] = len(clusters) - 1, len(clusters[-1])
            clusters[-1].append(r[5] or b"")
            size += len(r[5] or b"")
    directory = []
    for i, (space, path, title, mime, redirect, _) in enumerate(rows):
        names = path.encode() + b"\0" + (b"" if title == path else title.encode()) + b"\0"
        if redirect is None:
            directory.append(struct.pack("<HBcIII", media.index(mime or ""), 0, space.encode(), 0, *where[i]) + names)
        else:
            directory.append(struct.pack("<HBcII", REDIRECT, 0, space.encode(), 0, place[space, redirect]) + names)
    bodies = []
    for blobs in clusters:
        offsets = [4 * (len(blobs) + 1)]
        for b in blobs:
            offsets.append(offsets[-1] + len(b))
        bodies.append(bytes([ZSTD]) + pa.compress(struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(blobs), "zstd", asbytes=True))
    listed = "".join(f"{m}\0" for m in media).encode() + b"\0"
    media_at = struct.calcsize(HEADER)
    paths_at = media_at + len(listed)
    titles_at = paths_at + 8 * len(rows)
    clusters_at = titles_at + 4 * len(rows)
    entries_at = clusters_at + 8 * len(bodies)
    bodies_at = entries_at + sum(map(len, directory))
    end = bodies_at + sum(map(len, bodies))
    titles = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][2].encode()))
    head = struct.pack(HEADER, MAGIC, 5, 0, uuid.uuid4().bytes, len(rows), len(bodies), paths_at, titles_at, clusters_at, media_at, NOTHING, NOTHING, end)
    out = [head, listed, struct.pack(f"<{len(rows)}Q", *_running(entries_at, directory)), struct.pack(f"<{len(rows)}I", *titles), struct.pack(f"<{len(bodies)}Q", *_running(bodies_at, bodies)), *directory, *bodies]
    whole = b"".join(out)
    return whole + hashlib.md5(whole).digest()


def _running(at: int, parts: list[bytes]) -> list[int]:
    out = []
    for p in parts:
        out.append(at)
        at += len(p)
    return out
