"""Token counts that follow edits.

Each document keeps a segment tree over blocks of pre-tokens: bytes and tokens of every block, summed up to the root.
Whether a text may be cut at a place depends on two bytes before it and one after it, so an edit can change blocks only
where it touches them or that context. Only those blocks are encoded again; the sums above them are updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navella.llm.arrowtext import each_slice, slices, utf8
from navella.llm.shared import with_fields
from navella.llm.tokens import SLICE, TextEncoder, text_column

#: Pieces in a block when a tree is built; a block that grows beyond GROWN times the bytes makes its tree anew.
BLOCK_PIECES = 32
GROWN_BYTES = 2048
#: Bytes around an edit whose cuts depend on it.
CONTEXT = 2


class SegmentTree:
    """Bytes and tokens of a document's blocks with their sums: node k has the children 2k and 2k + 1."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray):
        self.leaves = 1 << max(0, (len(sizes) - 1).bit_length()) if len(sizes) else 1
        self.bytes, self.tokens = (self._sums(x) for x in (sizes, tokens))

    def _sums(self, x: np.ndarray) -> list[int]:
        level = np.zeros(self.leaves, np.int64)
        level[: len(x)] = x
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def find(self, place: int) -> tuple[int, int]:
        """(block that holds the byte at place, its first byte); the last block with bytes if beyond the end."""
        node, begin = 1, 0
        place = min(place, self.bytes[1] - 1)
        while node < self.leaves:
            node *= 2
            if place - begin >= self.bytes[node]:
                begin += self.bytes[node]
                node += 1
        return node - self.leaves, begin

    def set(self, leaf: int, size: int, tokens: int) -> None:
        node = leaf + self.leaves
        size, tokens = size - self.bytes[node], tokens - self.tokens[node]
        while node:
            self.bytes[node] += size
            self.tokens[node] += tokens
            node //= 2

    def blocks(self) -> tuple[list[int], list[int]]:
        return self.bytes[self.leaves :], self.tokens[self.leaves :]


def blocks_of(sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over runs of BLOCK_PIECES pieces."""
    if not len(sizes):
        return sizes, tokens
    at = np.arange(0, len(sizes), BLOCK_PIECES)
    return np.add.reduceat(sizes, at), np.add.reduceat(tokens, at)


class EditedText:
    """A text and its segment tree under edits."""

    def __init__(self, text: str, tree: SegmentTree, encoder: TextEncoder):
        self.text, self.tree, self.encoder = bytearray(text.encode()), tree, encoder
        self.ascii = text.isascii()
        self.encoded_bytes = 0

    def _bytes_at(self, start: int, stop: int) -> tuple[int, int]:
        """The bytes at which the characters start and stop begin, both held within the text."""
        if self.ascii:
            start = min(max(start, 0), len(self.text))
            return start, min(max(stop, start), len(self.text))
        b = np.frombuffer(bytes(self.text), np.uint8)
        at = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
        start = min(max(start, 0), len(at) - 1)
        return int(at[start]), int(at[min(max(stop, start), len(at) - 1)])

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts new in the place of the characters from start up to stop, both held within the text."""
        first, last = self._bytes_at(start, stop)
        put = new.encode()
        self.ascii &= new.isascii()
        if self.tree.bytes[1] == 0:
            leaf = end_leaf = begin = 0
            end = 0
        else:
            leaf, begin = self.tree.find(max(0, first - CONTEXT))
            end_leaf, end = self.tree.find(max(first, last + CONTEXT - 1))
            end += self.tree.bytes[end_leaf + self.tree.leaves]
        self.text[first:last] = put
        end += len(put) - (last - first)
        region = bytes(self.text[begin:end])
        self.encoded_bytes += len(region)
        self.tree.set(leaf, len(region), self.encoder.count_ids(region))
        for k in range(leaf + 1, end_leaf + 1):
            self.tree.set(k, 0, 0)
        if len(region) > GROWN_BYTES:
            self._split(leaf, region)

    def _split(self, leaf: int, region: bytes) -> None:
        """Makes the tree anew with that block parted; no other block is encoded again."""
        b = np.frombuffer(region, np.uint8)
        bounds, number, _ = self.encoder.pieces(b, np.array([0, len(b)]))
        parts = blocks_of(np.diff(bounds), self.encoder.memory.sizes(number))
        sizes, tokens = self.tree.blocks()
        merged = [np.array(x[:leaf] + p.tolist() + x[leaf + 1 :], np.int64) for x, p in zip((sizes, tokens), parts, strict=True)]
        kept = merged[0] > 0
        self.tree = SegmentTree(merged[0][kept], merged[1][kept])


def blocks_of_each(encoder: TextEncoder, b: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes, tokens) of the blocks of each text of a slice."""
    if not len(b):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(off) - 1)
    bounds, number, places = encoder.pieces(b, off)
    n, size = encoder.memory.sizes(number), np.diff(bounds)
    return [blocks_of(size[x:y], n[x:y]) for x, y in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


def edited(doc: EditedText, edits: list | None) -> EditedText:
    """doc after a row's edits."""
    for e in edits or []:
        if e is not None:
            doc.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
    return doc


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def token_trees(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """docs with the blocks of each text's segment tree (tree_bytes, tree_tokens) and n_tokens. A null text is
    empty: no block, 0 tokens."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(vocabulary_path)
        try:
            for batch in batches:
                for i, j, b, off in each_slice(batch.column("text"), SLICE):
                    trees = blocks_of_each(encoder, b, off)
                    at = pa.array(np.cumsum([0, *(len(t) for _, t in trees)]), pa.int32())
                    sizes, tokens = (pa.ListArray.from_arrays(at, pa.array(np.concatenate([t[k] for t in trees]).astype(np.int32))) for k in (0, 1))
                    total = pa.array([int(t.sum()) for _, t in trees], pa.int64())
                    yield _with(batch.slice(i, j - i), tree_bytes=sizes, tree_tokens=tokens, n_tokens=total)
        finally:
            encoder.forget()

    rows = docs.drop("tree_bytes", "tree_tokens", "n_tokens").withColumn("text", text_column(docs))
    return rows.mapInArrow(build, with_fields(rows.schema, "tree_bytes array<int>, tree_tokens array<int>, n_tokens long"))


def apply_edits(trees: DataFrame, vocabulary_path: str) -> DataFrame:
    """trees (as of token_trees) with a column edits, an array of (start, stop, text) in the order in which they
    are made, each on the text that the one before it left. Places are in characters and held within the text; a
    null array has no edit, a null text in an edit is empty, null places are 0. Returns the columns with text, tree and
    n_tokens as edited, and encoded_bytes, the bytes that were encoded again."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(vocabulary_path)
        kinds = {"text": pa.string(), "tree_bytes": pa.list_(pa.int32()), "tree_tokens": pa.list_(pa.int32()), "n_tokens": pa.int64(), "encoded_bytes": pa.int64()}
        try:
            for whole in batches:
                for i, j in slices(utf8(whole.column("text"))[0], SLICE):
                    batch, done = whole.slice(i, j - i), []
                    for text, sizes, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree_bytes", "tree_tokens", "edits")), strict=True):
                        doc = edited(EditedText(text, SegmentTree(np.array(sizes, np.int64), np.array(tokens, np.int64)), encoder), edits)
                        done.append((doc.text.decode(), *doc.tree.blocks(), doc.tree.tokens[1], doc.encoded_bytes))
                    made = dict(zip(kinds, zip(*done, strict=True), strict=True))
                    names = [*batch.schema.names, "encoded_bytes"]
                    yield pa.RecordBatch.from_arrays([pa.array(made[c], kinds[c]) if c in made else batch.column(c) for c in names], names=names)
        finally:
            encoder.forget()

    trees = trees.drop("encoded_bytes")
    return trees.mapInArrow(edit, with_fields(trees.schema, "encoded_bytes long"))


def edited_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, tokens_before, tokens_after, bytes_after and encoded_bytes of docs (doc_id, text, edits, as apply_edits has
    them), for those who want the counts alone: trees are made and edited in one pass, in slices of about SLICE bytes,
    so that no tree and no edited text leaves its task. Null texts are empty; an empty table gives no row."""
    schema = "doc_id long, tokens_before long, tokens_after long, bytes_after long, encoded_bytes long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(vocabulary_path)
        names = [c.split()[0] for c in schema.split(", ")]
        try:
            for whole in batches:
                for i, j, b, off in each_slice(whole.column("text"), SLICE):
                    batch, found = whole.slice(i, j - i), []
                    trees = blocks_of_each(encoder, b, off)
                    for text, edits, (sizes, tokens) in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), trees, strict=True):
                        doc = edited(EditedText(text, SegmentTree(sizes, tokens), encoder), edits)
                        found.append((int(tokens.sum()), doc.tree.tokens[1], len(doc.text), doc.encoded_bytes))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=names)
        finally:
            encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"), "edits")
    return rows.mapInArrow(count, schema)


def edit(start: Column, stop: Column, text: Column) -> Column:
    """One entry of the column edits."""
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.alias("text"))
