"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The upper tree is fitted in numpy on a bounded sample; where the corpus gives its leaves more than SPLIT_ROWS vectors,
Spark fits a subtree for each of them on vectors of its own, so that leaves grow in number, not in size, up to MOST_LEAVES
of them. Spark puts every vector into its leaf. A query walks the tree best bin first, through a priority queue, and
visits as many leaves as a calibration asks for: a bounded sample of queries is searched exactly over all vectors, and
visits are widened until the wanted share of those neighbours is reached. Runs of neighbouring leaves meet blocks of queries, each
query with the leaves of the run that its walk comes to, so a query is sent and answered once a run and no group grows with
the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navella.llm.shared import stored

#: Vectors, those of the smallest hashes of vec_id, that the tree is fitted on at most.
SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 64
#: A leaf of the upper tree with more vectors than this gets a subtree, fitted on at most SUBTREE_ROWS of them.
SPLIT_ROWS = 4 * LEAF_ROWS
SUBTREE_ROWS = 20_000
#: Leaves of the whole tree, which goes to every executor, about at most.
MOST_LEAVES = 200_000
ROUNDS = 8
#: Queries that the number of visits is calibrated on at most, and the recall wanted of them.
CALIBRATION_QUERIES = 200
RECALL = 0.95
#: Vectors in a run of leaves, or in a part of a larger leaf, and queries in a block, at most about.
BLOCK = 32768
QUERY_BLOCK = 8192
#: Tasks that runs and blocks are compared in at most.
MOST_TASKS = 4096


@dataclass
class Tree:
    """centre of each node; its children from first up to first + count, none for a leaf; number of each leaf."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def grown(self, subtrees: dict[int, Tree]) -> Tree:
        """The tree with subtrees in the place of leaves, its leaves numbered anew."""
        parts = [(self.centre, self.first.copy(), self.count.copy(), self.leaf.copy())]
        size, leaves = len(self.leaf), 0
        node_of = {int(n): k for k, n in enumerate(self.leaf) if n >= 0}
        for number, node in node_of.items():
            sub = subtrees.get(number)
            if sub is None or sub.leaves < 2:
                parts[0][3][node] = leaves
                leaves += 1
                continue
            # the subtree's root is the leaf's own node; its other nodes follow at the end
            parts[0][1][node], parts[0][2][node], parts[0][3][node] = size + sub.first[0] - 1, sub.count[0], -1
            inner = sub.count[1:] > 0
            parts.append((sub.centre[1:], np.where(inner, sub.first[1:] + size - 1, 0), sub.count[1:], np.where(inner, -1, sub.leaf[1:] + leaves)))
            size += len(sub.leaf) - 1
            leaves += sub.leaves
        return Tree(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11, least: int | None = None) -> Tree:
        """least: a part of fewer rows stays a leaf (LEAF_ROWS, unless given)."""
        least = LEAF_ROWS if least is None else least
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        centre, first, count, leaf = [x.mean(0)], [0], [0], [-1]
        queue, leaves = [(0, np.arange(len(x)))], 0
        while queue:
            node, rows = queue.pop(0)
            parts = _split(x[rows], rng) if len(rows) > least else None
            if parts is None:
                leaf[node] = leaves
                leaves += 1
                continue
            centres, own = parts
            first[node], count[node] = len(centre), len(centres)
            for k in range(len(centres)):
                queue.append((len(centre), rows[own == k]))
                centre.append(centres[k])
                first.append(0)
                count.append(0)
                leaf.append(-1)
        return cls(np.array(centre), np.array(first), np.array(count), np.array(leaf))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at each node."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(node[self.count[node] > 0])
            if not len(inner):
                return self.leaf[node]
            for k in inner:
                at = np.flatnonzero(node == k)
                c = self.centre[self.first[k] : self.first[k] + self.count[k]]
                node[at] = self.first[k] + np.argmin((c * c).sum(1) - 2 * (x[at] @ c.T), 1)

    def visit(self, q: np.ndarray, number: int, start: int = 0) -> list[int]:
        """The first leaves below start, up to number, that a best-bin-first walk comes to."""
        heap, out = [(0.0, start)], []
        while heap and len(out) < number:
            _, node = heapq.heappop(heap)
            n = int(self.count[node])
            if n == 0:
                out.append(int(self.leaf[node]))
                continue
            first = int(self.first[node])
            for k, s in enumerate((self.centre[first : first + n] @ q).tolist()):
                heapq.heappush(heap, (-s, first + k))
        return out

    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(nodes, their parents) of each level below the root."""
        out, nodes = [], np.zeros(1, np.int64)
        while len(nodes := nodes[self.count[nodes] > 0]):
            n = self.count[nodes]
            parents = np.repeat(nodes, n)
            nodes = np.repeat(self.first[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((nodes, parents))
        return out

    def visited(self, q: np.ndarray, number: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(query, leaf) whether visit gives the leaf among the first, for many queries at once. A walk comes to leaves in the
        order of the least product on the way down to each; leaves that share it stand below one node, and only where the
        last ones do, a walk from that node tells which."""
        score = q @ self.centre.T
        score[:, 0] = np.inf
        least = score.copy()
        for nodes, parents in levels:
            least[:, nodes] = np.minimum(score[:, nodes], least[:, parents])
        ends = np.flatnonzero(self.leaf >= 0)
        ends = ends[np.argsort(self.leaf[ends])]
        least_of_leaf = least[:, ends]
        number = min(number, len(ends))
        last = np.partition(least_of_leaf, len(ends) - number, axis=1)[:, len(ends) - number]
        out = least_of_leaf > last[:, None]
        same = least_of_leaf == last[:, None]
        missing = number - out.sum(1)
        for k in np.flatnonzero(same.sum(1) > missing):
            node = np.flatnonzero((score[k] == last[k]) & (least[k] == last[k]))
            same[k] = False
            if len(node) > 1:  # equal products of several nodes
                out[k] = False
                same[k, self.visit(q[k], number)] = True
            else:
                same[k, self.visit(q[k], int(missing[k]), int(node[0]))] = True
        return out | same


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """(centres, part of each row) by k-means; None if the rows don't part."""
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    c = distinct[rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        own = np.argmin((c * c).sum(1) - 2 * (x @ c.T), 1)
        kept, own = np.unique(own, return_inverse=True)
        c = np.stack([x[own == k].mean(0) for k in range(len(kept))])
    return (c, own) if len(c) > 1 else None


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows, the same whatever block they stand in: products of 32-bit numbers are whole in
    double precision, and their sum is rounded once."""
    return (q * c).astype(np.longdouble).sum(1).astype(np.float64)


def top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate row, score) of each query's k nearest among x but its own row, of those that are allowed (query,
    candidate row); ties to the smaller id."""
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    if allowed is not None:
        scores[~allowed] = -np.inf
    # k of many interleaved strips have their greatest scores at or above this, so k scores are
    n = min(k, x.shape[0])
    strips = min(8 * n, x.shape[0])
    whole = x.shape[0] // strips * strips
    most = scores[:, :whole].reshape(len(q), -1, strips).max(1)
    least = np.partition(most, strips - n, axis=1)[:, strips - n]
    margin = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(least), least, 0)))
    rows, cols = np.nonzero((scores >= (least - margin)[:, None]) & np.isfinite(scores))
    s = exact(q[rows], x[cols])
    order = np.lexsort((ids[cols], -s, rows))
    rows, cols, s = rows[order], cols[order], s[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k], s[rank < k]


def runs_of(sizes: np.ndarray) -> np.ndarray:
    """The first leaf of each run of leaves that hold BLOCK vectors together at most; a larger leaf is a run of its own."""
    first, held = [0], 0
    for leaf, n in enumerate(sizes.tolist()):
        if leaf > first[-1] and held + n > BLOCK:
            first.append(leaf)
            held = 0
        held += n
    return np.array(first)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that take part, and their dimension: those of the most frequent length (the
    smaller of equals) that are not null or zero and hold neither null nor non-finite numbers."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    v = v.filter(finite & F.exists("embedding", lambda e: e != 0))
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1
    return v.filter(F.size("embedding") == dim), dim


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The k nearest found for each vector that fulfils is_query, among all others: query_id, rank, vec_id, score.
    vectors: vec_id, embedding; other columns aren't looked at. Repeated rows of an id are candidates each; a query id
    is searched once, by its first vector. An empty table gives no row."""
    spark = vectors.sparkSession
    every, dim = usable(vectors)
    # Of equal vectors no more than k rows of an id, and none beyond the k + 1 smallest ids, can be among any k nearest.
    equal = [F.xxhash64("embedding"), F.col("embedding")]  # sorted by the hash, vectors are hardly compared
    place_of_id = F.dense_rank().over(Window.partitionBy(*equal).orderBy("vec_id"))
    copy = F.row_number().over(Window.partitionBy(*equal, "vec_id").orderBy("vec_id"))
    candidates = every.withColumn("place", place_of_id).filter(F.col("place") <= k + 1).withColumn("copy", copy).filter(F.col("copy") <= k)
    candidates = stored(candidates.select("vec_id", "embedding"), "candidates")
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    upper = Tree.fit(matrix(sample.column("embedding").combine_chunks(), dim))
    tree = spark.sparkContext.broadcast(with_subtrees(candidates, upper, dim))  # MOST_LEAVES of them, about, at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.assign(matrix(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=["vec_id", "embedding", "leaf"])

    placed = stored(candidates.mapInArrow(place, f"vec_id long, embedding {every.schema['embedding'].dataType.simpleString()}, leaf int"), "leaves")
    queries = every.filter(is_query).withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("embedding"))))
    queries = queries.filter("copy = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    visits = calibrated(placed, queries, tree.value, dim, k, recall)
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row for each leaf
        sizes[r["leaf"]] = r["count"]
    first = runs_of(sizes)
    run_of_leaf = np.repeat(np.arange(len(first)), np.diff([*first, len(sizes)]))
    held = np.bincount(run_of_leaf, sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = tree.value.levels()
        step = max(1, (1 << 21) // len(tree.value.leaf))
        for batch in batches:
            q = matrix(batch.column("embedding"), dim)
            for i in range(0, len(q), step):
                found = tree.value.visited(q[i : i + step], visits, levels)
                for run, (a, b) in enumerate(zip(first, [*first[1:], len(sizes)], strict=True)):
                    at = np.flatnonzero(found[:, a:b].any(1))
                    if len(at) and held[run]:
                        leaves = pa.array([row.tobytes() for row in np.packbits(found[at, a:b], axis=1)], pa.binary())
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(i + at)), pa.array(np.full(len(at), run, np.int32)), leaves], names=["query_id", "run", "leaves"])

    walked = stored(queries.mapInArrow(walk, "query_id long, run int, leaves binary"), "visits")
    asked = {r["run"]: -(-r["count"] // QUERY_BLOCK) for r in walked.groupBy("run").count().collect()}
    own = {run: -(-int(held[run]) // BLOCK) for run in asked}
    tasks = min(MOST_TASKS, max(1, sum(2 * n * own[run] for run, n in asked.items())))
    runs = F.broadcast(spark.createDataFrame([(run, own[run], n) for run, n in asked.items()], "run int, own_blocks int, query_blocks int"))
    of_leaf = [(leaf, int(run), own[int(run)], asked[int(run)]) for leaf, run in enumerate(run_of_leaf) if int(run) in asked]  # a row for each leaf
    leaves = F.broadcast(spark.createDataFrame(of_leaf, "leaf int, run int, own_blocks int, query_blocks int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["run", "query_block", "own_block"]
    asks = walked.join(queries, "query_id").join(runs, "run").withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
    asks = asks.select("run", "query_block", each("own_blocks").alias("own_block"), "query_id", "embedding", "leaves").repartition(tasks, *keys)
    offers = placed.join(leaves, "leaf").withColumn("own_block", F.pmod(F.xxhash64("vec_id"), F.col("own_blocks")).cast("int"))
    offers = offers.select("run", each("query_blocks").alias("query_block"), "own_block", "vec_id", "embedding", "leaf").repartition(tasks, *keys)

    def compare(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        right = right.sort_by("leaf")
        q_ids, ids = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (right, "vec_id")))
        q, x = (matrix(t.column("embedding").combine_chunks(), dim) for t in (left, right))
        leaf, walks = right.column("leaf").to_numpy() - first[key[0].as_py()], left.column("leaves").to_pylist()
        parts = []
        for i in range(0, len(q), 128):
            bits = np.unpackbits(np.stack([np.frombuffer(w, np.uint8) for w in walks[i : i + 128]]), axis=1).astype(bool)
            at = np.flatnonzero(bits.any(0)[leaf])
            if len(at):
                a, b, s = top(q_ids[i : i + 128], q[i : i + 128], ids[at], x[at], k, bits[:, leaf[at]])
                parts.append((q_ids[i : i + 128][a], ids[at][b], s))
        return pa.table({n: np.concatenate(c) for n, c in zip(empty, zip(*parts, strict=True), strict=True)} if parts else empty)

    found = asks.groupBy(*keys).cogroup(offers.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def with_subtrees(vectors: DataFrame, upper: Tree, dim: int) -> Tree:
    """The tree with a subtree in each leaf that holds more than SPLIT_ROWS of vectors, fitted in Spark on vectors of that
    leaf, a bounded number for each: all, if there are no more, else those of the smallest hashes of vec_id, about."""
    shared = vectors.sparkSession.sparkContext.broadcast(upper)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(leaf.astype(np.int32))], names=["vec_id", "leaf"])

    sizes = {r["leaf"]: r["count"] for r in vectors.mapInArrow(place, "vec_id long, leaf int").groupBy("leaf").count().collect()}  # a row for each leaf
    large = {k: n for k, n in sizes.items() if n > SPLIT_ROWS}
    if not large:
        return upper
    rows = min(SUBTREE_ROWS, -(-MOST_LEAVES * LEAF_ROWS // upper.leaves))
    least = {k: max(LEAF_ROWS * min(n, rows) // n, BRANCHES) for k, n in large.items()}  # of the fitted rows, so that a leaf holds LEAF_ROWS of all

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("embedding"), dim))
            part = np.array([min(1.0, rows / large[k]) if k in large else 0.0 for k in leaf.tolist()])
            kept = pa.array(batch.column("place").to_numpy() < part)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf.astype(np.int32))], names=["vec_id", "embedding", "leaf"]).filter(kept)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        leaf = table.column("leaf")[0].as_py()
        sub = Tree.fit(matrix(table.column("embedding").combine_chunks(), dim), least=least[leaf])
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "centre": [sub.centre.astype("<f8").tobytes()], "nodes": [np.stack([sub.first, sub.count, sub.leaf]).astype("<i8").tobytes()]})

    schema = f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, leaf int"
    spread = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    found = vectors.withColumn("place", spread).mapInArrow(chosen, schema).groupBy("leaf").applyInArrow(fit, "leaf int, centre binary, nodes binary").collect()
    subtrees = {}
    for r in found:
        first, count, leaf = np.frombuffer(bytes(r["nodes"]), "<i8").reshape(3, -1)
        subtrees[r["leaf"]] = Tree(np.frombuffer(bytes(r["centre"]), "<f8").reshape(-1, dim), first, count, leaf)
    return upper.grown(subtrees)


def calibrated(placed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float) -> int:
    """Leaf visits by which the wanted share of the exact neighbours of a bounded sample of queries is reached."""
    sample = queries.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(CALIBRATION_QUERIES).toArrow()
    if not sample.num_rows:
        return 1
    q_ids, q = sample.column("query_id").to_numpy(), matrix(sample.column("embedding").combine_chunks(), dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
                a, b, s = top(q_ids, q, ids, matrix(batch.column("embedding"), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[b]), pa.array(s), pa.array(leaf[b])], names=["q", "vec_id", "score", "leaf"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = placed.mapInArrow(nearest, "q long, vec_id long, score double, leaf int").withColumn("rank", F.row_number().over(order))
    places = [{leaf: i for i, leaf in enumerate(tree.visit(x, tree.leaves))} for x in q]
    rows = best.filter(F.col("rank") <= k).select("q", "leaf").collect()  # k rows a calibration query
    needed = np.sort([places[r["q"]][r["leaf"]] + 1 for r in rows])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1
