"""Token ids in a binary file format, coded by a static range asymmetric numeral system (rANS).

Layout of a file: magic, then the frequency table that all its blocks share (symbols present and their
frequencies, which sum to 2**16), then blocks. A block holds whole documents: their ids and lengths, and the
token ids coded in interleaved lanes. It is coded by itself; every ``SPAN_STEPS`` steps it has a checkpoint (lane
states, place in the words, CRC-32 of the span's ids), so blocks, and spans inside a block, decode in parallel
and each is verified. Files are written by Spark tasks over documents in ascending doc_id order; the manifest that
the tasks return names the blocks of the tasks that succeeded, so files of lost tasks are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navella.llm.shared import shared_folder, stored
from navella.llm.tokens import TextEncoder, text_column

MAGIC = b"NVRANS01"
BITS = 16
TOTAL = 1 << BITS
LANES = 2048
SPAN_STEPS = 64
#: A block is closed with the document that brings it to so many ids, and a file likewise.
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 23
_HEAD = struct.Struct("<QQIIII")  # documents, ids, lanes, words, spans, CRC-32 of all that follows


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**16, at least 1 for each symbol that occurs."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * TOTAL // total), 0)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - TOTAL
    if over < 0:
        f[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        take = min(over, int(f[i]) - 1)
        f[i] -= take
        over -= take
    return f


class Table:
    """A shared frequency table with what coding needs of it."""

    def __init__(self, f: np.ndarray):
        self.f = f.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f)), f).astype(np.uint32)

    def to_bytes(self) -> bytes:
        present = np.flatnonzero(self.f)
        body = present.astype("<u4").tobytes() + self.f[present].astype("<u4").tobytes()
        return struct.pack("<II", len(present), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        n, crc = struct.unpack_from("<II", raw)
        body = raw[8 : 8 + 8 * n]
        if zlib.crc32(body) != crc:
            raise ValueError("frequency table: wrong checksum")
        at, f = np.frombuffer(body, "<u4", n), np.frombuffer(body, "<u4", n, 4 * n)
        table = np.zeros(int(at.max()) + 1 if n else 0, np.int64)
        table[at] = f
        return cls(table)


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES, span_steps: int = SPAN_STEPS) -> tuple[int, list[bytes]]:
    """(number of words, parts of the block after its document table). Lane k codes the ids k, k + lanes, ..."""
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, TOTAL, np.uint64)
    words: list[np.ndarray] = []
    done, marks = 0, []
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, state = table.f[s], x[: len(s)]
        full = state >= f << np.uint64(16)
        out = (state[full] & np.uint64(0xFFFF)).astype("<u2")
        words.append(out)
        done += len(out)
        state = np.where(full, state >> np.uint64(16), state)
        q = state // f
        x[: len(s)] = (q << np.uint64(BITS)) + (state - q * f) + table.cum[s]
        if t % span_steps == 0:
            crc = zlib.crc32(ids[t * lanes : (t + span_steps) * lanes].astype("<u4").tobytes())
            marks.append((done, crc, x.astype("<u4").tobytes()))
    spans = b"".join(struct.pack("<II", done - at, crc) + states for at, crc, states in reversed(marks))
    return done, [spans, b"".join(w.tobytes() for w in reversed(words))]


def decode_span(n: int, at: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """n ids from a checkpoint on."""
    lanes = len(states)
    x = states.astype(np.uint64)
    out = np.empty(n, np.uint32)
    for i in range(0, n, lanes):
        state = x[: min(lanes, n - i)]
        slot = state & np.uint64(TOTAL - 1)
        s = table.symbol[slot]
        out[i : i + len(s)] = s
        state = table.f[s] * (state >> np.uint64(BITS)) + slot - table.cum[s]
        low = np.flatnonzero(state < TOTAL)
        state[low] = (state[low] << np.uint64(16)) | words[at : at + len(low)]
        at += len(low)
        x[: len(state)] = state
    return out


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    docs = doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
    lanes = min(LANES, max(1, len(ids)))
    words, parts = encode_ids(ids, table, lanes)
    body = docs + b"".join(parts)
    return _HEAD.pack(len(doc_ids), len(ids), lanes, words, -(-len(ids) // (lanes * SPAN_STEPS)), zlib.crc32(body)) + body


def read_block(raw: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, token ids), each span checked against its checksum."""
    docs, n, lanes, n_words, spans, crc = _HEAD.unpack_from(raw)
    at = _HEAD.size
    if zlib.crc32(raw[at:]) != crc:
        raise ValueError("block: wrong checksum")
    doc_ids, lengths = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    size = 8 + 4 * lanes
    words = np.frombuffer(raw, "<u2", n_words, at + spans * size).astype(np.uint64)
    out = np.empty(n, np.uint32)
    for k in range(spans):
        word, crc = struct.unpack_from("<II", raw, at + k * size)
        states = np.frombuffer(raw, "<u4", lanes, at + k * size + 8)
        i = k * lanes * SPAN_STEPS
        j = min(n, i + lanes * SPAN_STEPS)
        out[i:j] = decode_span(j - i, word, states, words, table)
        if zlib.crc32(out[i:j].astype("<u4").tobytes()) != crc:
            raise ValueError(f"span {k}: wrong checksum")
    return doc_ids, lengths, out


_MANIFEST = "path string, part long, file_no long, block_no long, table_bytes long, offset long, length long, start long, n_ids long, n_docs long"


def write_id_files(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the ids of docs (doc_id, text), each with end_id appended, in ascending doc_id order (null ids
    first, equal ids by a hash of their text, then the text), and returns the manifest: a row for each block. Null
    text is empty, so every document has at least one id; repeated rows are written each. An empty table gives an empty
    manifest and no file. A task writes as many files as its documents need and holds the ids of one at a time."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "id-files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    names = [c.split()[0] for c in _MANIFEST.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = TextEncoder.of(vocabulary_path), TaskContext.get()
        files, root = fs.FileSystem.from_uri(folder)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = n_files = 0

        def written() -> pa.RecordBatch:
            doc, size, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at = np.concatenate([[0], np.cumsum(size)])
            table = Table(frequencies(np.bincount(ids, minlength=end_id + 1)))
            files.create_dir(root, recursive=True)
            name = f"part-{task.partitionId():06d}-{n_files:05d}-{task.taskAttemptId()}.rans"
            found, i = [], 0
            with files.open_output_stream(f"{root}/{name}") as out:
                head = MAGIC + table.to_bytes()
                out.write(head)
                place = len(head)
                while i < len(doc):
                    j = min(len(doc), max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_IDS))))
                    raw = write_block(doc[i:j], size[i:j], ids[at[i] : at[j]], table)
                    out.write(raw)
                    found.append((f"{folder}/{name}", task.partitionId(), n_files, len(found), len(head), place, len(raw), int(at[i]), int(at[j] - at[i]), j - i))
                    place += len(raw)
                    i = j
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=names)

        try:
            for batch in batches:
                doc_ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                for i, j, ids, at in encoder.encode(batch.column(1)):
                    held.append((doc_ids[i:j].copy(), np.diff(at) + 1, np.insert(ids, at[1:], end_id).astype(np.uint16)))
                    n_held += len(held[-1][2])
                    if n_held >= FILE_IDS:
                        yield written()
                        n_held, n_files = 0, n_files + 1
            if held:
                yield written()
        finally:
            encoder.forget()

    return stored(ordered.mapInArrow(write, _MANIFEST), "id-manifest")


def read_id_files(manifest: DataFrame) -> DataFrame:
    """Every document of the manifest's blocks from the files: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    files = manifest.groupBy("path", "part", "file_no").agg(F.sum("n_ids").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task that wrote: their running sum is small
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", running(Window.orderBy("part")).alias("of_part"))
    files = files.withColumn("of_file", running(Window.partitionBy("part").orderBy("file_no"))).join(parts, "part")
    base = files.select("path", (F.col("of_part") + F.col("of_file")).alias("base"))
    blocks = manifest.join(base, "path").select("path", "table_bytes", "offset", "length", (F.col("base") + F.col("start")).alias("start"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Table] = {}
        for batch in batches:
            for row in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(row["path"])
                with files.open_input_file(path) as source:
                    if path not in tables:
                        head = source.read_at(row["table_bytes"], 0)
                        if head[:8] != MAGIC:
                            raise ValueError(f"{path} is no id file")
                        tables = {path: Table.from_bytes(head[8:])}
                    doc, size, ids = read_block(source.read_at(row["length"], row["offset"]), tables[path])
                at = np.concatenate([[0], np.cumsum(size)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                null = doc == -(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), pa.array(row["start"] + at[:-1]), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
