"""Exact join of word shingle sets by Jaccard similarity, with PartEnum signatures.

Sets are taken by bands of sizes; two sets of similarity 0.8 or more lie in one band or in neighbouring ones and so share an
instance, in which at most k elements differ. The instance deals the domain of shingles into more than k / 2 groups,
so in some group at most one element differs, and each group into three parts: the three ways to leave one part out are
the group's signatures, of which such sets share one. Signatures over nothing are left out as long as more than k / 2 of a
set's groups have elements in two parts or more, which already guarantees one over something; else all are emitted.

No pair of a bucket is missed and large buckets aren't paired off: equal sets are one class from the start; each bucket is
first compared with its best-connected member, of several such the most followed one; only members that are then still in
different components are paired, if sketches of the sets don't rule it out, and in large buckets only if they agree under a second,
independent parting too (which similar sets do). Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from navella.llm.arrowtext import each_slice, lower_ascii, mix, word_hashes
from navella.llm.shared import discard, stored
from navella.llm.tokens import text_column

WORDS = 5
#: Signatures that one group of the join holds, about.
GROUP_SIGNATURES = 1_000_000
#: Signatures that a task gathers before it hands them on.
BATCH_SIGNATURES = 1_500_000
#: From so many members on a bucket is parted a second time.
LARGE = 2048
#: Classes (two numbers each) that go to every executor at most; beyond it texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Classes on one side of a block of the last comparison, and members of one side of a salted bucket, about.
BLOCK = 512
#: 64-bit words of a sketch.
SKETCH = 8
_U = np.uint64
_STEP = mix(np.arange(1, WORDS + 1, dtype=_U)) | _U(1)
_SALT = mix(np.arange(101, 111, dtype=_U))


def sets_of(b: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted hashes of each document's shingles: WORDS words in a row, A-Z lower-cased; with fewer words the
    whole sequence; none without words."""
    h, at = word_hashes(lower_ascii(b), off)
    padded = np.concatenate([h, np.zeros(WORDS - 1, _U)])
    g = np.zeros(len(h), _U)
    for j in range(WORDS):
        g += padded[j : j + len(h)] * _STEP[j]
    g = mix(g)
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if y - x >= WORDS:
            yield np.unique(g[x : y - WORDS + 1])
        elif y > x:
            yield mix((h[x:y] * _STEP[: y - x]).sum(keepdims=True, dtype=_U) + _SALT[y - x])
        else:
            yield np.zeros(0, _U)


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([mix(s ^ _SALT[8]).sum(dtype=_U) + _U(len(s))]))[0].astype(np.int64))


def bands(limit: int) -> list[int]:
    """The largest size of each band; a band's sizes are within a factor of 1.25."""
    tops, low = [], 1
    while low <= limit:
        tops.append(5 * low // 4)
        low = tops[-1] + 1
    return tops


_TOPS = np.array(bands(1 << 40))


def parting(instance: int) -> tuple[int, int]:
    """(k, number of groups) of an instance, which joins the sets of a band with each other and with the band below.
    For similarity 0.8 the sizes a and b allow (a + b) / 9 different elements. The groups beyond k / 2 + 1 make up for
    those with too few elements."""
    k = int(2 * _TOPS[instance] // 9)
    few = 0.07 * (k // 2 + 1)
    return k, k // 2 + 1 + (int(np.ceil(few + 1.3 * np.sqrt(few))) if k > 1 else 0)


def signatures(s: np.ndarray, seed: int = 0) -> np.ndarray:
    """Signatures of a sorted set; seed 1 gives another, independent parting."""
    return np.concatenate(list(by_instance(s, seed).values())) if len(s) else s


def by_instance(s: np.ndarray, seed: int = 0) -> dict[int, np.ndarray]:
    """The same by instance, of a set that isn't empty."""
    e = s if seed == 0 else np.sort(mix(s ^ _SALT[9]))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(e ^ _SALT[7]))])
    band = int(np.searchsorted(_TOPS, len(s)))
    out = {}
    for instance in (band, band + 1):
        k, groups = parting(instance)
        name = _U(instance) << _U(44)
        if k == 0:
            out[instance] = mix(mix(np.array([name])) + total[-1])
            continue
        n = 3 * groups
        at = np.append(np.searchsorted((e >> _U(32)) * _U(n) >> _U(32), np.arange(n, dtype=_U)), len(e))
        held = (at[1:] - at[:-1]).reshape(groups, 3)
        sums = (total[at[1:]] - total[at[:-1]]).reshape(groups, 3)
        rest = held.sum(1, keepdims=True) - held
        keys = mix(name + np.arange(n, dtype=_U)).reshape(groups, 3) + (sums.sum(1, keepdims=True, dtype=_U) - sums)
        rich = int(((held > 0).sum(1) >= 2).sum())
        out[instance] = mix(keys[rest > 0] if rich > k // 2 else keys.ravel())
    return out


def places(held: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(where each instance's signatures begin, how wide they lie, number of groups), in groups of about GROUP_SIGNATURES.
    held: number of shingles by band. A set's signatures are of two instances and so lie in few groups, to each of which
    its class is sent once."""
    size = np.zeros(max(held, default=0) + 2)
    for band, n in held.items():
        size[band : band + 2] += n / 2
    groups = max(1, round(size.sum() / GROUP_SIGNATURES))
    width = size * groups / max(size.sum(), 1.0)
    return np.cumsum(width) - width, width, groups


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def sketch_of(s: np.ndarray) -> list[int]:
    """Whether the number of elements is odd in each of 64 * SKETCH cells, as signed words. One element more or less
    changes one bit, so sets differ in at least as many elements as their sketches do in bits."""
    odd = np.bincount((s >> _U(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def cells_of(s: np.ndarray) -> bytes:
    """The same for a power of two cells, at least as many as elements: an eighth of a byte an element or so."""
    n = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Elements that the sets of two such sketches differ in, at least; the longer one is folded to the other's length."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def plausible(a: str, b: str):
    """Condition that sizes and sketches (columns n and s0, s1, ... of the two aliases) allow similarity 0.8: the sets may
    differ in (n + n) / 9 elements."""
    bits = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH)), F.lit(0))
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (4 * x <= 5 * y) & (4 * y <= 5 * x) & (9 * bits <= x + y)


WORDS_OF_SKETCH = [f"s{k}" for k in range(SKETCH)]


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, s0, s1, ...): documents of one class have equal sets; the class and the sketch of an
    empty set are null."""
    nothing = (0, None, *[None] * SKETCH)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), class_of(s), *sketch_of(s)) if len(s) else nothing for _, _, b, off in each_slice(batch.column("text")) for s in sets_of(b, off)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=["doc_id", "n_shingles", "class", *WORDS_OF_SKETCH])

    return docs.mapInArrow(name, "doc_id long, n_shingles long, class long, " + ", ".join(f"{w} long" for w in WORDS_OF_SKETCH))


def buckets(docs: DataFrame, held: dict[int, int]) -> DataFrame:
    """(key, class, hub): the members of each bucket of two or more classes, and the member best connected in its
    group. Buckets of the same members are one; key names it. held: number of shingles by band."""
    begin, width, groups = places(held)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        instances: list[np.ndarray] = []
        names: list[int] = []
        seen: set[int] = set()

        def handed() -> pa.RecordBatch:
            flat, size, of = np.concatenate(sigs), [len(x) for x in sigs], np.concatenate(instances)
            owner = np.repeat(np.arange(len(sigs), dtype=np.uint16), size)
            part = np.minimum((begin[of] + width[of] * ((flat >> _U(32)) / 2**32)).astype(np.int32), groups - 1)
            order = np.argsort(part, kind="stable")
            part, flat, owner = part[order], flat[order], owner[order]
            low = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # the group holds what the rest says
            at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            rows = []
            for x, y in zip(at[:-1], at[1:], strict=True):
                own, n = np.unique(owner[x:y], return_counts=True)  # sorted, as the order by part is stable
                rows.append((int(part[x]), low[x:y].tobytes(), n.astype("<u4").tobytes(), np.array(names, np.int64)[own].tobytes()))
            sigs.clear()
            instances.clear()
            names.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "low", "counts", "classes"])

        total = 0
        for batch in batches:
            for _, _, b, off in each_slice(batch.column("text")):
                for s in sets_of(b, off):
                    name = class_of(s)
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    found = by_instance(s)
                    sigs.append(np.concatenate(list(found.values())))
                    instances.append(np.repeat(list(found), [len(x) for x in found.values()]).astype(np.uint8))
                    names.append(name)
                    total += len(sigs[-1])
                    if total >= BATCH_SIGNATURES or len(names) == 65_000:
                        yield handed()
                        total = 0
        if sigs:
            yield handed()

    def meet(table: pa.Table) -> pa.Table:
        sig, cls = [], []
        for low, counts, names in zip(*(table.column(c).to_pylist() for c in ("low", "counts", "classes")), strict=True):
            wide = np.zeros((len(low) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
            sig.append(wide.view("<u8").ravel())
            cls.append(np.repeat(np.frombuffer(names, np.int64), np.frombuffer(counts, "<u4")))
        s, c = np.concatenate(sig), np.concatenate(cls)
        order = np.lexsort((c, s))
        s, c = s[order], c[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
        s, c = s[new], c[new]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(first, len(s)))
        kept = np.repeat(size > 1, size)
        c, size = c[kept], size[size > 1]
        if not len(c):
            return pa.table({"key": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "hub": pa.array([], pa.int64())})
        first = np.cumsum(size) - size
        key = np.add.reduceat(mix(c.astype(_U)), first) + size.astype(_U)
        known, degree = np.unique(c, return_inverse=True)
        degree = np.bincount(degree, np.repeat(size, size).astype(float), len(known))[degree]
        order = np.lexsort((c, -degree, np.repeat(np.arange(len(size)), size)))
        hub = np.repeat(c[order][first], size)
        one = np.zeros(len(size), bool)
        one[np.unique(key, return_index=True)[1]] = True
        one = np.repeat(one, size)
        return pa.table({"key": np.repeat(key.astype(np.int64), size)[one], "class": c[one], "hub": hub[one]})

    found = docs.select("text").mapInArrow(emit, "part int, low binary, counts binary, classes binary")
    met = found.groupBy("part").applyInArrow(meet, "key long, class long, hub long")
    return met.groupBy("key", "class").agg(F.min("hub").alias("hub"))


def sets_for(pairs: DataFrame, docs: DataFrame, small: DataFrame) -> DataFrame:
    """(class, second, n, cells, shingles) of the classes in pairs, from one document of each. second: whether the class is
    the b of some pair. small: classes with one_id, that document."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: rows that share an id come to one task
        for batch in batches:
            for i, j, b, off in each_slice(batch.column("text")):
                own = (batch.column(c).slice(i, j - i).to_pylist() for c in ("class", "second"))
                found = [(c, second, len(s), cells_of(s), s.tobytes()) for s, c, second in zip(sets_of(b, off), *own, strict=True) if len(s) and c not in seen and class_of(s) == c and not seen.add(c)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["class", "second", "n", "cells", "shingles"])

    ends = pairs.select(F.col("a").alias("class"), F.lit(False).alias("second")).union(pairs.select("b", F.lit(True)))
    wanted = ends.groupBy("class").agg(F.max("second").alias("second"))
    one = stored(small.join(wanted, "class").select("class", "one_id", "second"), "wanted")
    one = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
    return docs.join(one, docs["doc_id"] == one["one_id"]).select("class", "second", "text").mapInArrow(shingles, "class long, second boolean, n long, cells binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar. Sets, which are long, go only to pairs that sketches by each
    set's own size don't rule out."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_cells", "b_cells")), strict=True)
            good = [9 * differing(x, y) <= n + m for n, m, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a_shingles"), batch.column("b_shingles")
            good = [similar(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def beside(rows: DataFrame, *columns: str) -> DataFrame:
        for end, side in (("a", sets), ("b", sets.filter("second"))):
            rows = rows.join(side.select(F.col("class").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)
        return rows

    near = stored(beside(pairs, "n", "cells").mapInArrow(sift, "a long, b long"), "near-pairs")
    met = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = sets.join(F.broadcast(met) if near.count() <= BROADCAST_ROWS else met, "class", "left_semi")
    return beside(near, "shingles").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node that can be reached. Every node is merged
    into its smallest neighbour, and links between merged nodes are what the next round works on, so they soon run out."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("src", "dst"), "edges")
    labels = edges.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    first, own = edges, labels  # these others may still read
    while not edges.isEmpty():
        earlier = [edges] if edges is not first else []
        into = stored(edges.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("of"), F.least("src", "low").alias("to")), "merged")
        moved = stored(labels.join(into, labels["label"] == into["of"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = edges.join(into.toDF("src", "x"), "src").join(into.toDF("dst", "y"), "dst")
        edges = stored(ends.filter("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct(), "edges")
        for table in [*earlier, into, *([labels] if labels is not own else [])]:
            discard(table)
        labels = moved
    return labels


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends have different labels."""
    of = [labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("a", "b")]
    rows = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return rows.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def across(entries: DataFrame, labels: DataFrame, small: DataFrame, docs: DataFrame, done: DataFrame) -> DataFrame:
    """The plausible pairs (a, b) of a bucket's members that are in different components and not in done."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mix(signatures(np.frombuffer(s.as_buffer(), _U), 1) + _U(k & (1 << 64) - 1)) for k, s in zip(batch.column("key").to_pylist(), batch.column("shingles"), strict=True)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            key = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("class").take(at), batch.column("label").take(at)], names=["key", "class", "label"])

    members = entries.join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("label", "class").alias("label"))
    mixed = lambda m: m.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key", "size")
    members = stored(members.join(mixed(members), "key"), "mixed-buckets")
    both = members.filter(F.col("size") < LARGE).select("key", "class", "label")
    large = members.filter(F.col("size") >= LARGE)
    if not large.isEmpty():
        sets = sets_for(large.select(F.col("class").alias("a"), F.col("class").alias("b")), docs, small)
        parted = stored(large.join(sets, "class").select("key", "class", "label", "shingles").mapInArrow(again, "key long, class long, label long"), "parted-buckets")
        both = both.unionByName(parted.join(mixed(parted), "key", "left_semi"))
    both = both.join(small.drop("one_id"), "class")
    open_pair = (F.col("l.class") < F.col("r.class")) & (F.col("l.label") != F.col("r.label"))
    pairs = both.alias("l").join(both.alias("r"), (F.col("l.key") == F.col("r.key")) & open_pair & plausible("l", "r"))
    return pairs.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct().join(done, ["a", "b"], "left_anti")


def candidates(entries: DataFrame, labels: DataFrame, small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, size) of the components whose classes are all compared with each other, in blocks: those of BLOCK classes at
    most and those whose buckets hold more pairs than the component; and the plausible pairs (a, b) of classes of the
    other components that share a signature."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    few = F.col("size") <= BLOCK
    members = entries.join(labels.withColumnRenamed("node", "class"), "class").join(sizes.filter(~few).select("label"), "label", "left_semi").select("key", "class", "label")
    buckets = members.groupBy("key", "label").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("x")).filter("size > 1")
    buckets = stored(buckets.groupBy("label", "size", "x").agg(F.min("key").alias("key")).drop("x"), "own-buckets")
    work = buckets.groupBy("label").agg(F.sum(F.col("size") * (F.col("size") - 1)).alias("work"))
    whole = sizes.join(work, "label", "left").filter(few | (F.col("work") >= F.col("size") * (F.col("size") - 1))).select("label", "size")
    whole = stored(whole, "whole-components")
    parts = members.join(buckets.join(whole, "label", "left_anti"), ["key", "label"]).select("key", "label", "class", "size")
    parts = stored(parts.join(small.drop("one_id"), "class").withColumn("salts", F.ceil(F.col("size") / BLOCK).cast("int")), "bucket-members")
    left = parts.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"))
    right = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "label", "salt")]
    pairs = left.alias("l").join(right.alias("r"), same[0] & same[1] & same[2] & (F.col("l.class") < F.col("r.class")) & plausible("l", "r"))
    return whole, pairs.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct()


def allowed(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The places (i, j) in left and right of sets that sizes and sketches allow to be similar; each two once, if left is right."""
    n = np.array([len(s) for s in sets])
    words = np.array([sketch_of(s) for s in sets], np.int64).view(_U)
    bits = np.zeros((len(left), len(right)), np.int64)
    for k in range(SKETCH):
        bits += np.bitwise_count(words[left, k][:, None] ^ words[right, k][None, :])
    x, y = n[left][:, None], n[right][None, :]
    good = (4 * x <= 5 * y) & (4 * y <= 5 * x) & (9 * bits <= x + y)
    if left is right:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    return list(zip(left[i].tolist(), right[j].tolist(), strict=True))


def links(entries: DataFrame, labels: DataFrame, small: DataFrame, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of classes whose sets are similar; with rows (class, rows) instead (class, others), in
    parts to be added up: the rows of the classes that it is linked to, of which no list of pairs is made. labels: the exact
    components, so no link leads out of one. Sets are sent to blocks of pairs, not to each pair."""
    whole, pairs = candidates(entries, labels, small)
    pairs = stored(pairs, "candidates")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    bundles = max(1, labels.count() // BLOCK)
    large, blocks = F.col("size") > BLOCK, F.ceil(F.col("size") / BLOCK).cast("int")
    bundle = F.when(large, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bundles)))
    of = labels.join(sizes, "label").select("node", "label", large.alias("large"), bundle.alias("bundle"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    of = stored(of, "blocks")
    keys = ["large", "bundle", "x", "y"]
    pairs = pairs.join(of.select(F.col("node").alias("a"), "large", "bundle", F.col("block").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    pairs = stored(pairs.select(*keys, "a", "b"), "blocked-pairs")
    teams = stored(of.join(whole.select("label", blocks.alias("blocks")), "label"), "teams")
    ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("class")).distinct().select(*keys, "class", F.lit(None).cast("long").alias("team"), F.lit(0).alias("block"))
    other = teams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = stored(ends.unionByName(other.select("large", "bundle", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("node").alias("class"), F.col("label").alias("team"), "block")), "ends")
    alone = teams.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = stored(sets_for(pairs.select("a", "b").unionByName(alone), docs, small), "sets").select("class", "cells", "shingles")
    if rows is not None:
        sets = sets.join(rows, "class")
    counts = rows is not None

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        cls, block = (held.column(c).to_numpy() for c in ("class", "block"))
        cells = held.column("cells").to_pylist()
        own = [np.frombuffer(s, _U) for s in held.column("shingles").to_pylist()]
        at = {c: i for i, c in enumerate(cls.tolist())}
        ask = [(at[a], at[b]) for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True) if a in at and b in at]
        teams: dict[int, list[int]] = {}
        for i, t in enumerate(held.column("team").to_pylist()):
            if t is not None:
                teams.setdefault(t, []).append(i)
        for places in teams.values():
            x, y = held.column("x")[0].as_py(), held.column("y")[0].as_py()
            members = [own[i] for i in places]
            left, right = (np.flatnonzero(block[places] == k) for k in (x, y))
            ask += [(places[i], places[j]) for i, j in allowed(members, left, left if x == y else right)]
        found = [(i, j) for i, j in ask if 9 * differing(cells[i], cells[j]) <= len(own[i]) + len(own[j]) and similar(own[i], own[j])]
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        if counts:
            weight = held.column("rows").to_numpy()
            others = np.zeros(len(cls), np.int64)
            np.add.at(others, i, weight[j])
            np.add.at(others, j, weight[i])
            return pa.table({"class": cls[others > 0], "others": others[others > 0]})
        return pa.table({"a": np.minimum(cls[i], cls[j]), "b": np.maximum(cls[i], cls[j])})

    asked = pairs.groupBy(*keys).cogroup(ends.join(sets, "class").groupBy(*keys))
    return asked.applyInArrow(compare, "class long, others long" if counts else "a long, b long")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, class, sketch), one row a class, buckets, and the label of each linked class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    named = stored(classes(docs), "classes")
    band = F.size(F.filter(F.array(*map(F.lit, bands(1 << 40))), lambda top: top < F.col("n_shingles")))
    held = dict(named.filter("n_shingles > 0").groupBy(band.alias("band")).agg(F.sum("n_shingles")).collect())  # a row a band, 130 at most
    one = [F.first(w).alias(w) for w in WORDS_OF_SKETCH]  # equal within a class
    small = stored(named.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("one_id"), F.first("n_shingles").alias("n"), *one), "small")
    entries = stored(buckets(docs, held), "buckets")
    pairs = entries.filter("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    likely = pairs.join(small.alias("l"), F.col("a") == F.col("l.class")).join(small.alias("r"), (F.col("b") == F.col("r.class")) & plausible("l", "r"))
    likely = stored(likely.select("a", "b"), "hub-pairs")
    # each class first meets its most followed hub alone; then other pairs only where that left components apart
    followed = likely.join(likely.groupBy("b").agg(F.count("*").alias("followers")), "b")
    best = stored(followed.groupBy("a").agg(F.max(F.struct("followers", "b")).alias("best")).select("a", "best.b"), "best-hubs")
    links = stored(verified(best, stored(sets_for(best, docs, small), "sets")), "links")
    labels = components(links)
    done = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for more in (lambda: apart(likely, labels).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), lambda: across(entries, labels, small, docs, done)):
        rest = stored(more(), "pairs")
        if rest.isEmpty():
            continue
        found = stored(verified(rest, stored(sets_for(rest, docs, small), "sets")), "links")
        done = done.unionByName(rest)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    return named, small, entries, labels


def component_of(small: DataFrame, labels: DataFrame) -> DataFrame:
    """component_id and label (one for all classes of a component) by class."""
    own = small.select("class", F.col("one_id").alias("least_id"))
    own = own.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = own.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return own.join(least, "label").select("class", "component_id", "label")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, class) and component_id by class. docs: doc_id, text; other columns aren't looked
    at. Null and empty texts have an empty set and the null class. Repeated rows are in one class; a class whose rows
    have no id has no component_id and links to nothing. Links within a component are not all looked for."""
    named, small, _, labels = joined(docs)
    return named.select("doc_id", "n_shingles", "class"), component_of(small, labels)


def similar_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole join: documents and component_id by class, as of join, and every link (a, b), a < b, between different classes.
    Documents of one class are linked to each other too."""
    named, small, entries, labels = joined(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return named.select("doc_id", "n_shingles", "class"), component_of(small, labels), links(entries, labels, small, plain)


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) and n_links (the other
    rows it is linked to, those of an equal set included) of every row."""
    named, small, entries, labels = joined(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    rows = stored(named.filter("class is not null").groupBy("class").agg(F.count("*").alias("rows")), "rows")
    linked = links(entries, labels, small, plain, rows).groupBy("class").agg(F.sum("others").alias("others"))
    found = component_of(small, labels)
    found = found.join(rows, "class").join(linked, "class", "left").select(F.col("class").alias("of"), "component_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = named.join(found, named["class"] == F.col("of"), "left")
    none = F.col("class").isNull()
    return rows.select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id; of several rows of that id in the
    component one of the smallest class name. Rows without ids come after all others. Documents without words all
    stay."""
    named, found = join(docs)
    found = stored(found, "components")
    empty = named.filter("class is null").select("doc_id")
    kept = found.select(F.col("component_id").alias("kept_id")).union(empty.select(F.col("doc_id").alias("kept_id"))).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
    repeated = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("many")), "repeated-ids")
    if repeated.isEmpty():
        return rows
    # an id of several rows doesn't tell which of them is meant: their sets do
    many = rows["doc_id"].cast("long").eqNullSafe(repeated["many"])
    odd = rows.join(repeated, many, "left_semi")
    whole = odd.select(F.struct(*(odd[c] for c in docs.columns)).alias("row"), odd["doc_id"].cast("long").alias("doc_id"), text_column(odd).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [class_of(s) if len(s) else None for _, _, b, off in each_slice(batch.column("text")) for s in sets_of(b, off)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(names, pa.int64())], names=["row", "own_id", "class"])

    schema = StructType([whole.schema["row"], *StructType.fromDDL("own_id long, class long").fields])
    classed = whole.mapInArrow(name, schema).join(found, "class", "left").filter(F.col("class").isNull() | F.col("own_id").eqNullSafe(F.col("component_id")))
    order = Window.partitionBy("label").orderBy("class")
    one = classed.filter("class is not null").withColumn("place", F.row_number().over(order)).filter("place = 1")
    chosen = one.select("row.*").unionByName(classed.filter("class is null").select("row.*"))
    return rows.join(repeated, many, "left_anti").select(*docs.columns).unionByName(chosen.select(*docs.columns))
