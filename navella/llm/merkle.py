"""A Merkle manifest of a dataset: one tree for each partition value, and one over their roots.

The trees are stored in blocks: aligned subtrees of ``HEIGHT`` levels of hashing, one row each, in the layout of van Emde
Boas. A block's levels are split at half height; the upper half lies first, then the lower subtrees from left to right,
each split likewise. ``address`` finds any node by arithmetic, so building a block and reading siblings need no pointers.
The roots of blocks are the leaves of the next blocks, up to one block a tree; then the roots of trees are the leaves of
the outer tree. Blocks are built by one task each and stored; texts are hashed where they are read and never shuffled.

A node is the lowercase hexadecimal SHA-256 of its children's, of one child where the last has no partner; it is stored as
its 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navella.llm.shared import numbered, stored

#: Levels of hashing in a block: 256 leaves, 511 nodes, 16 KB.
HEIGHT = 8
#: What a level does to a digest: a partner on its right, on its left, or none.
RIGHT, LEFT, ALONE = 0, 1, 2


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where nodes of a depth (the root's is 0) lie in a block of so many levels of hashing."""
    levels, base, index = height + 1, np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        levels -= upper
        depth -= upper
        base += (1 << upper) - 1 + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return base


def height_of(total: int, most: int) -> int:
    """Levels of hashing in a block of a tree with so many leaves, of most at most."""
    return most if total > 1 << most else (total - 1).bit_length()


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def lay_out(digests: list[bytes], height: int) -> bytes:
    """The nodes of a block above these leaves, at their addresses; places without a node are zero."""
    nodes, row = np.zeros(((2 << height) - 1, 32), np.uint8), [x.hex() for x in digests]
    for depth in range(height, -1, -1):
        nodes[address(height, depth, np.arange(len(row)))] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        row = [parent(row[i : i + 2]) for i in range(0, len(row), 2)]
    return nodes.tobytes()


def siblings(nodes: bytes, height: int, n: int) -> Iterator[tuple[str, bytes]]:
    """For each of a block's n leaves the partners of the nodes on its way to the block's root, upward, as hexadecimal text,
    and what each level does."""
    at = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    found, steps = [], np.empty((n, height), np.uint8)
    for up in range(height):
        index, count = np.arange(n) >> up, ((n - 1) >> up) + 1
        other = index ^ 1
        steps[:, up] = np.where(other >= count, ALONE, index & 1)
        hexed = at[address(height, height - up, np.minimum(other, count - 1))].tobytes().hex()
        found.append([hexed[64 * i : 64 * i + 64] for i in range(n)])
    for i in range(n):
        yield "".join(found[up][i] for up in range(height) if steps[i, up] != ALONE), steps[i].tobytes()


def fold(digest: str, proof: str, steps: bytes) -> str:
    """The root that a digest leads to by its partners."""
    at = 0
    for step in steps:
        if step == ALONE:
            digest = parent([digest])
            continue
        other = proof[at : at + 64]
        at += 64
        digest = parent([digest, other] if step == RIGHT else [other, digest])
    return digest


def blocks_of(rows: DataFrame, most: int, name: str) -> DataFrame:
    """rows (tree, place, total, digest, doc_id, claimed) as blocks: tree, block, total, n, nodes, root, doc_ids, claims."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total = table["total"][0].as_py()
        nodes = lay_out(table["digest"].to_pylist(), height_of(total, most))
        one = {"tree": [table["tree"][0].as_py()], "block": [table["block"][0].as_py()], "total": [total], "n": [len(table)], "nodes": [nodes], "root": [nodes[:32]]}
        lists = {"doc_ids": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())), "claims": pa.array([table["claimed"].to_pylist()], pa.list_(pa.binary()))}
        return pa.table(one | lists)

    grouped = rows.withColumn("block", F.shiftright("place", most)).groupBy("tree", "block")
    return stored(grouped.applyInArrow(build, "tree string, block long, total long, n long, nodes binary, root binary, doc_ids array<long>, claims array<binary>"), name)


def forest(rows: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The blocks of all trees over rows (tree, place, total, digest, doc_id, claimed), level by level of blocks."""
    levels = [blocks_of(rows, most, name)]
    while not (over := levels[-1].filter(F.col("total") > 1 << most)).isEmpty():
        none = F.lit(None)
        above = over.select("tree", F.col("block").alias("place"), F.shiftright(F.col("total") + ((1 << most) - 1), most).alias("total"), F.col("root").alias("digest"), none.cast("long").alias("doc_id"), none.cast("binary").alias("claimed"))
        levels.append(blocks_of(above, most, name))
    return levels


def roots(levels: list[DataFrame], most: int) -> DataFrame:
    """(tree, level, root) of every tree; level is that of its topmost block."""
    tops = [blocks.filter(F.col("total") <= 1 << most).select("tree", F.lit(k).alias("level"), "root") for k, blocks in enumerate(levels)]
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return found


UP = "tree string, block long, up_proof string, up_steps binary, subroot string, whole string"


def lowest(levels: list[DataFrame], tops: DataFrame, most: int) -> DataFrame:
    """The blocks of documents with the rest of the way from their roots: up_proof, up_steps, subroot, whole (the root of
    all). tops (tree, level, up_proof, up_steps, subroot, whole): the way from each tree's root."""

    def way(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(siblings(r["nodes"], height_of(r["total"], most), r["n"]))
                n, first = len(found), r["block"] << most
                columns = [[r["tree"]] * n, list(range(first, first + n)), [p + r["up_proof"] for p, _ in found], [s + r["up_steps"] for _, s in found], [r["subroot"]] * n, [r["whole"]] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()), strict=True)], ["tree", "block", "up_proof", "up_steps", "subroot", "whole"])

    found = None
    for k in reversed(range(len(levels))):
        up = tops.filter(F.col("level") == k).withColumn("block", F.lit(0).cast("long")).drop("level")
        up = up if found is None else up.unionByName(found)
        joined = levels[k].join(up, ["tree", "block"])
        if k == 0:
            return joined
        found = joined.select("tree", "block", "total", "n", "nodes", "up_proof", "up_steps", "subroot", "whole").mapInArrow(way, UP)


def counted(name: str, value: Column) -> Column:
    """A field of a leaf: - if null, or else its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")).alias(name)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a document's row, of 32 bytes."""
    fields = [counted(str(k), c) for k, c in enumerate((doc_id, source, lang, n_chars, text))]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def document_leaf(n_chars: Column | None = None) -> Column:
    """leaf of the columns of documents, or with another n_chars."""
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))


PROOFS = "doc_id long, leaf string, subroot string, root string, proof string, steps binary, folded_root string, verified boolean"


def proofs(docs: DataFrame, claimed: Column, most: int = HEIGHT) -> DataFrame:
    """For every row of docs (doc_id, source, lang, n_chars, text): leaf, the root of its language's tree (subroot), the root of
    all, its proof (the partners' digests from leaf to root, joined) with steps, and the root that the claimed digest
    (32 bytes; null: one that nothing matches) leads to by them. Languages in bytewise order, null first, are the
    outer tree's leaves; a null language's documents are a tree like others. Leaves ascend by doc_id, null first, then by
    digest, so repeated rows are leaves each and lie next to each other. Null fields are ``-``, empty ones ``0:``. A table
    without rows has no trees and no proofs. most: levels of hashing in a block. Further columns are not read."""
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = docs.select(tree.alias("tree"), "doc_id", document_leaf().alias("digest"), claimed.alias("claimed"))
    inner = forest(numbered(rows, "tree", ["doc_id", "digest"], "merkle-leaves"), most, "merkle-blocks")
    subroots = roots(inner, most)
    none = F.lit(None)
    outer_rows = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("inner"), "level", F.col("root").alias("digest"), none.cast("long").alias("doc_id"), none.cast("binary").alias("claimed")), "tree", ["inner"], "merkle-subroots")
    outer_rows = stored(outer_rows, "merkle-subroots")
    outer = forest(outer_rows.drop("inner", "level"), most, "merkle-outer")
    whole = F.lower(F.hex("root"))
    start = roots(outer, most).select("tree", "level", F.lit("").alias("up_proof"), F.lit(b"").alias("up_steps"), none.cast("string").alias("subroot"), whole.alias("whole"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(siblings(r["nodes"], height_of(r["total"], most), r["n"]))
                places = range(r["block"] << most, (r["block"] << most) + len(found))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([p + r["up_proof"] for p, _ in found], pa.string()), pa.array([s + r["up_steps"] for _, s in found], pa.binary()), pa.array([r["whole"]] * len(found), pa.string())], ["place", "up_proof", "up_steps", "whole"])

    ways = lowest(outer, start, most).select("block", "total", "n", "nodes", "up_proof", "up_steps", "whole").mapInArrow(each, "place long, up_proof string, up_steps binary, whole string")
    tops = stored(outer_rows.join(ways, "place").select(F.col("inner").alias("tree"), "level", "up_proof", "up_steps", F.lower(F.hex("digest")).alias("subroot"), "whole"), "merkle-ways")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                height, n = height_of(r["total"], most), r["n"]
                at = address(height, height, np.arange(n))
                own = np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32)[at].tobytes().hex()
                out = []
                for i, (proof, steps) in enumerate(siblings(r["nodes"], height, n)):
                    proof, steps = proof + r["up_proof"], steps + r["up_steps"]
                    root = fold((r["claims"][i] or b"").hex(), proof, steps)
                    out.append((r["doc_ids"][i], own[64 * i : 64 * i + 64], r["subroot"], r["whole"], proof, steps, root, root == r["whole"]))
                types = (pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof", "steps", "folded_root", "verified"])

    return lowest(inner, tops, most).select("total", "n", "nodes", "doc_ids", "claims", "up_proof", "up_steps", "subroot", "whole").mapInArrow(verify, PROOFS)
