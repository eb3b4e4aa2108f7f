"""Packing documents into sequences of a fixed number of tokens.

Lengths lie between 1 and the capacity, so the whole packing is decided on the histogram of lengths, which has at
most one entry a length whatever the corpus holds: pieces above a third of the capacity are matched greedily (at most
two fit a sequence), smaller ones go best-fit into the remaining gaps, groups of equal sequences at a time. The plan says,
for each length, which ranks go where; Spark numbers the pieces within their length and looks their places up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navella.llm.shared import stored
from navella.llm.tokens import TextEncoder, text_column


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """counts[l]: number of pieces of length l. Returns placements as rows (length, first rank, number, first
    sequence, offset), the k-th of them being in sequence first + k, and the number of sequences."""
    left = [int(c) for c in counts] + [0] * (capacity + 1 - len(counts))
    given = [0] * (capacity + 1)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    n = 0

    def place(length: int, number: int, first: int, offset: int) -> None:
        rows.append((length, given[length], number, first, offset))
        given[length] += number
        left[length] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap > 0 and number > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, number))

    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > third and (left[b] == 0 or b == a and left[a] < 2):
                b -= 1
            if b <= third:
                number = left[a]
                place(a, number, n, 0)
                leave(capacity - a, n, number)
            else:
                number = left[a] // 2 if a == b else min(left[a], left[b])
                place(a, number, n, 0)
                place(b, number, n, a)
                leave(capacity - a - b, n, number)
            n += number
    for a in range(third, 0, -1):
        while left[a]:
            k = bisect.bisect_left(open_gaps, a)
            if k < len(open_gaps):
                gap = open_gaps[k]
                first, number = gaps[gap].pop()
                take = min(number, left[a])
                if take < number:
                    gaps[gap].append((first + take, number - take))
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(k)
                place(a, take, first, capacity - gap)
                leave(gap - a, first, take)
            else:
                each = capacity // a
                number = left[a] // each
                if number == 0:
                    number, each = 1, left[a]
                for i in range(each):
                    place(a, number, n, i * a)
                leave(capacity - each * a, n, number)
                n += number
    return np.array(rows, np.int64).reshape(-1, 5), n


def pieces_of(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int) -> DataFrame:
    """Every document's ids with end_id appended, cut into pieces only where they exceed the capacity (the first
    piece takes what is over): part, doc_id, piece, start, length, ids_crc32, and rank within part and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = TextEncoder.of(vocabulary_path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        try:
            for batch in batches:
                doc_ids = batch.column(0)
                for i, j, ids, at in encoder.encode(batch.column(1)):
                    ids = np.insert(ids, at[1:], end_id).astype("<u4")
                    at = at + np.arange(len(at))
                    size = np.diff(at)
                    n_pieces = -(-size // capacity)
                    owner = np.repeat(np.arange(len(size)), n_pieces)
                    piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                    over = (size - 1) % capacity + 1  # of the first piece
                    start = np.where(piece == 0, 0, over[owner] + (piece - 1) * capacity)
                    length = np.where(piece == 0, over[owner], capacity)
                    raw = memoryview(ids.tobytes())
                    begin = (4 * (at[owner] + start)).tolist()
                    crc = [zlib.crc32(raw[x : x + 4 * y]) for x, y in zip(begin, length.tolist(), strict=True)]
                    rank = []
                    for y in length.tolist():
                        rank.append(seen[y])
                        seen[y] += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(owner), part, np.int32)), doc_ids.slice(i, j - i).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank, pa.int64())],
                        names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"],
                    )
        finally:
            encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(cut, "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long")


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Packs docs (doc_id, text) into few sequences of at most capacity tokens: a row for each piece with doc_id,
    piece, start, length, ids_crc32, sequence_id and offset. Null text is empty and makes a piece of the end id
    alone; repeated rows are packed each; an empty table gives no row. Other columns are not looked at."""
    pieces = stored(pieces_of(docs, vocabulary_path, end_id, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most a row for each length
        counts[length] = n
    rows, _ = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    far = np.int64(1) << 50
    keys = rows[:, 0] * far + rows[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * far + rank, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[k, 3] + rank - rows[k, 1]), pa.array(rows[k, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
