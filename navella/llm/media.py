"""Media columns: images kept in archives, written and read by a Spark data source.

An archive is a run of members, each a PNG image with a small header (key, length, CRC-32), followed by an index of
the members' places and its own length. ``write`` makes one archive a task and commits a manifest of the archives of
tasks that succeeded. ``read`` plans byte ranges over all archives of the directory; a range owns the members that begin
in it, streams them in Arrow batches, and reads a member again by its place if it comes back short or damaged.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from navella.llm.shared import shared_folder
from navella.llm.tokens import text_column

FORMAT = "navella_media"
WIDTH = 64
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
SCHEMA = "key long, n_bytes long, place string, media binary"
_MEMBER = struct.Struct("<qqIIB7x")  # key, bytes before padding, bytes of the image, CRC-32, 1 if the key is null
_TAIL = struct.Struct("<QII")  # place of the index, members, CRC-32 of the index
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    """The UTF-8 bytes with bytes 0 appended up to a positive multiple of WIDTH."""
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_of(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH samples a row, whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # the first byte of a row: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def samples_of(png: bytes) -> np.ndarray:
    """The samples of an image made by png_of, as rows; checks every chunk."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body, shape = 8, b"", (0, 0)
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + data)) != png[at + 8 + n : at + 12 + n]:
            raise ValueError("PNG chunk: wrong checksum")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("8-bit grey samples only")
            shape = (height, width)
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """A short description of an image: rows, mean and deviation of the samples, distinct samples, and the
    shares of dark, middle and bright ones, in thousandths."""
    n, mean = samples.size, float(samples.mean())
    bands = np.bincount(np.minimum(samples.ravel() >> 6, 2), minlength=3) * 1000 // n
    return f"rows={len(samples)};mean={mean:.3f};std={float(samples.std()):.3f};distinct={len(np.unique(samples))};bands={'/'.join(map(str, bands.tolist()))}"


@dataclass
class Archive(WriterCommitMessage):
    name: str
    size: int
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (key, n_bytes, payload) to an archive a task. Any other attempt at a task writes a file of another name."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        task = TaskContext.get()
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.media"
        places, at = [], 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for key, length, payload in zip(*batch.columns, strict=True):
                    png = png_of(payload.as_py())
                    k = key.as_py()
                    out.write(_MEMBER.pack(k or 0, length.as_py(), len(png), zlib.crc32(png), k is None) + png)
                    places.append(at)
                    at += _MEMBER.size + len(png)
            index = np.array(places, "<u8").tobytes()
            out.write(index + _TAIL.pack(at, len(places), zlib.crc32(index)))
        return Archive(name, at + len(index) + _TAIL.size, len(places))

    def commit(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps([[m.name, m.size, m.members] for m in messages if m is not None and m.members]).encode())

    def abort(self, messages: list) -> None:
        """Without a manifest nothing is read."""


@dataclass
class ByteRange(InputPartition):
    name: str
    size: int
    begin: int
    end: int


def read_member(source, name: str, place: int, attempts: int = ATTEMPTS) -> tuple[int | None, int, bytes]:
    """(key, bytes before padding, image) of the member at a place; tried again if what is read is short or damaged."""
    for k in range(attempts):
        try:
            key, length, n, crc, null = _MEMBER.unpack(source.read_at(_MEMBER.size, place))
            png = source.read_at(n, place + _MEMBER.size)
            if len(png) == n and zlib.crc32(png) == crc:
                return (None if null else key), length, png
            problem: Exception = ValueError("wrong checksum")
        except (OSError, struct.error) as e:
            problem = e
        time.sleep(0.05 * k)
    raise OSError(f"{name}, member at {place}: {problem}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ByteRange]:
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{root}/manifest.json") as source:
            archives = json.loads(source.read())
        return [ByteRange(name, size, at, at + RANGE_BYTES) for name, size, _ in archives for at in range(0, size, RANGE_BYTES)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(f"{root}/{partition.name}") as source:
            at, n, crc = _TAIL.unpack(source.read_at(_TAIL.size, partition.size - _TAIL.size))
            index = source.read_at(8 * n, at)
            if zlib.crc32(index) != crc:
                raise OSError(f"{partition.name}: damaged index")
            places = np.frombuffer(index, "<u8")
            rows: list[tuple] = []
            size = 0
            for place in places[(places >= partition.begin) & (places < partition.end)].tolist():
                key, length, png = read_member(source, partition.name, place)
                rows.append((key, length, f"{partition.name}@{place}", png))
                size += len(png)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "n_bytes": pa.int64(), "place": pa.string(), "media": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class MediaSource(DataSource):
    """Option path: a directory's URI that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)


def store_texts(docs: DataFrame, path: str | None = None) -> str:
    """Stores every text of docs (doc_id, text) as an image in archives and returns their directory. A null text
    is empty; an empty one is an image of one row of zeros. Keys may be null or repeated."""
    register(docs.sparkSession)
    path = path or shared_folder(docs.sparkSession, "media")

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                payload = pa.array([payload_of(t) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), payload], names=["key", "n_bytes", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_column(docs).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows.mapInArrow(payloads, "key long, n_bytes long, payload binary").write.format(FORMAT).mode("append").option("path", path).save()
    return path


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """key, n_bytes (of the text before padding), place and media (the stored image) of every member."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load()


def describe(media: DataFrame) -> DataFrame:
    """What the read images hold: doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 of the
    last WIDTH samples, media_bytes, media_sha256 and feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(key: int | None, n_bytes: int, png: bytes) -> tuple:
        samples = samples_of(png)
        payload = samples.tobytes()
        return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [one(*(x.as_py() for x in row)) for row in zip(*batch.columns, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("key", "n_bytes", "media").mapInArrow(features, schema)
