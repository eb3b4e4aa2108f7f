"""Toxicity by class-conditional Kneser-Ney models.

Two models of the next byte, one of toxic and one of ordinary documents, give each word two log-likelihoods. Each model looks
at the word from its beginning, which the blank before it marks, at most LONG - 1 bytes back. It backs off to the same counts
of both classes together, and these to the SHORT - 1 bytes before, so a rare expression is smoothed by what both classes
know of it, and one that only happens to stand in a toxic text tells little. Counts of the long runs are occurrences, those of
the short runs continuation counts (how many different long runs end in them); the absolute discounts are the Kneser-Ney
estimates from how many runs have counts 1 and 2. Bytes are the models' units, as compounds of toxic stems are unseen as
whole words.

Runs are counted exactly, over all labelled documents, in Spark. The models keep the sums of these counts by hash, in tables
of so many cells whatever the corpus, so what a driver or task holds is bounded and no run is left out; runs that share a
cell share its counts.

A document is judged by the difference of the toxic and the ordinary log-likelihood per word, of the share of its words that
are most toxic (two at least): normalised by length, yet not drowned by what is ordinary in a toxic text. A logistic line
over this one number gives a score between 0 and 1. Its slope is fitted on labelled rows left out of the counts; share and
the place of one half are those with the fewest errors on these rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navella.llm.arrowtext import each_slice, lower_ascii, prefix_sums, span_hashes
from navella.llm.quality import labelled_sample, labels_of
from navella.llm.shared import stored
from navella.llm.tokens import text_column

#: The logistic line is fitted on at most so many labelled rows of each class. The counts are of all labelled rows.
SAMPLE_ROWS = 2500
#: One labelled document in so many is left out of the counts by which the line sees it.
PARTS = 5
#: Shares of a document's words that are tried, and the words that are taken at least.
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.1)
WORDS = 2
#: What a toxic document that is kept weighs against a clean one that is rejected, where one half of the score is placed.
MISSED = 4.0
SLICE = 512 << 10
#: Runs that a task gathers before it counts them; different ones that it holds before it hands them on; and documents of a
#: slice that it numbers at once.
BATCH_RUNS = 1_000_000
HELD_RUNS = 1_000_000
SLICE_DOCS = 60_000
#: Labels (two numbers each) that go to every executor at most; beyond it texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Bytes of the long runs at most and at least, and of the short ones.
LONG, LEAST, SHORT = 12, 2, 3
#: Cells, as powers of two, of the long runs' table, of that of the bytes before their last, and of the same two of the short.
CELLS, BEFORE, SHORT_CELLS, SHORT_BEFORE = 22, 21, 18, 16
#: Cells, as a power of two, that a task packs together.
BLOCK = 14
_U = np.uint64


def canonical(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice of documents lower-cased, all but ASCII letters, digits and bytes beyond ASCII as spaces, and LONG spaces
    before each: (bytes, places of the documents' own bytes, their documents)."""
    b = lower_ascii(b)
    ink = (b >= 128) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(b)) + LONG * (1 + owner)
    out = np.full(len(b) + LONG * len(n), 32, np.uint8)
    out[place[ink]] = b[ink]
    return out, place, owner


def packed(b: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The n bytes (8 at most) that end at each place, as one number."""
    out = b[place].astype(_U)
    for k in range(1, n):
        out |= b[place - k].astype(_U) << _U(8 * k)
    return out


def long_runs(b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the long run that ends at each place, and of its bytes before the last. It begins at the last blank before
    the place, within its bounds of length."""
    blank = np.maximum.accumulate(np.where(b == 32, np.arange(len(b)), 0))
    first = place + 1 - np.clip(place + 1 - blank[place - 1], LEAST, LONG)
    sums = prefix_sums(b)
    return span_hashes(b, first, place + 1, sums), span_hashes(b, first, place, sums)


def cell(h: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each 64-bit hash, of 2**bits."""
    return (h >> _U(64 - bits)).astype(np.int64)


def short_cell(short, bits: int):
    """The cell of short runs, or of their bytes before the last, of 2**bits; numbers in an array, or a column."""
    if isinstance(short, Column):
        return F.shiftrightunsigned((short * _SPREAD).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)
    return ((short.astype(np.int64) * _SPREAD & 0xFFFFFFFF) >> (32 - bits)).astype(np.int64)


_SPREAD = 2654435761  # odd, and near the golden ratio's part of 2**32
RUNS = "run long, before long, short int, n0 int, n1 int, n2 int, n3 int"


def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Runs with what belongs to them and their counts (run, before, short, n0 to n3), each once."""
    run, before, short, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(run)
    run = run[order]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    return [run[first], before[order[first]], short[order[first]], *(np.add.reduceat(n[order], first, dtype=np.int32) for n in counts)]


def run_counts(texts: DataFrame) -> DataFrame:
    """(run, before, short, n0, n1, n2, n3): how often each long run stands in the texts, by code; hashes of it and of its
    bytes before the last, and its short run. texts: text, code (twice the label, plus 1 for the part left out). A task sums
    up before it hands on, so what is shuffled grows with its different runs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        fresh: list[list[np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            columns = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == _U else c) for c in columns], names=["run", "before", "short", "n0", "n1", "n2", "n3"])

        total = 0
        for batch in batches:
            code = batch.column("code").to_numpy().astype(np.int8)
            for i, j, b, off in each_slice(batch.column("text"), SLICE):
                for k in range(0, j - i, SLICE_DOCS):
                    part = off[k : k + SLICE_DOCS + 1]
                    text, place, owner = canonical(b[part[0] : part[-1]], part - part[0])
                    if len(place):
                        own = code[i + k + owner]
                        fresh.append(summed([[*long_runs(text, place), packed(text, place, SHORT).astype(np.int32), *((own == c).astype(np.int32) for c in range(4))]]))
                        total += len(fresh[-1][0])
                if total >= BATCH_RUNS:
                    held = [summed(held + fresh)]
                    fresh.clear()
                    total = 0
                    if len(held[0][0]) >= HELD_RUNS:
                        yield handed()
        if held or fresh:
            held = [summed(held + fresh)]
            yield handed()

    found = texts.mapInArrow(emit, RUNS)
    return found.groupBy("run").agg(F.first("before").alias("before"), F.first("short").alias("short"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))


def counted(n: list, label: int, whole: int):
    """A label's count, without (0) or with (1) the part left out. n: counts by code, arrays or columns."""
    return n[2 * label] + n[2 * label + 1] if whole else n[2 * label]


def discount(ones: float, twos: float) -> float:
    """The Kneser-Ney estimate of the absolute discount, between 0 and 1. ones, twos: how many runs have count 1, and 2."""
    return ones / (ones + 2 * twos) if ones else 0.0


def packed_table(t: np.ndarray) -> bytes:
    return zlib.compress(t.tobytes(), 1)


@cache
def of_halves(f: Callable) -> np.ndarray:
    """f of every number of half precision, by its bits."""
    with np.errstate(all="ignore"):
        return f(np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32))


def of_logs(x: np.ndarray, f: Callable) -> np.ndarray:
    """f (exp or expm1) of logarithms, in single precision."""
    return of_halves(f)[x.view(np.uint16)] if x.dtype == np.float16 else f(x)


class Rows:
    """A table of a row for each cell, compressed by blocks of 2**BLOCK cells in their order. It is unpacked where rows are
    first asked for, and sent to tasks in half precision, in which they hold it."""

    def __init__(self, parts: list[bytes], width: int, kind: type = np.float32):
        self.parts, self.width, self.kind, self.cells, self.rows = parts, width, kind, len(parts) << BLOCK, None

    def __len__(self) -> int:
        return self.cells

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        if self.rows is None:
            self.rows = np.empty((self.cells, self.width), self.kind)
            for k, part in enumerate(self.parts):
                self.rows[k << BLOCK : (k + 1) << BLOCK] = np.frombuffer(zlib.decompress(part), self.kind).reshape(-1, self.width)
            self.parts = None if self.kind == np.float16 else self.parts
        return self.rows[cells]

    def __reduce__(self) -> tuple:
        return Rows, ([packed_table(np.frombuffer(zlib.decompress(p), np.float32).astype(np.float16)) for p in self.parts], self.width, np.float16)


@dataclass
class Model:
    """For each cell of long runs their discounted counts by kind (ordinary, toxic, both
    together), as log(1 + count); for each cell of what is before their last byte the logarithm of one over the
    counts' sum, and what is left for the shorter run, by kind; for each cell of short runs their probability; the share
    of words; and the logistic line over the measure, bias first. An empty model has no cells and differences of 0."""

    left: Rows
    before: Rows
    short: np.ndarray
    share: float
    line: np.ndarray

    def __getstate__(self) -> dict:
        """What is sent to tasks: logarithms in half precision, compressed."""
        return self.__dict__ | {"short": packed_table(np.log(self.short).astype(np.float16))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"short": np.exp(np.frombuffer(zlib.decompress(state["short"]), np.float16).astype(np.float32))}

    def differences(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.left):
            return np.zeros(len(place))
        run, before = long_runs(text, place)
        rest = self.before[cell(before, BEFORE)]
        p = of_logs(self.left[cell(run, CELLS)], np.expm1) * of_logs(rest[:, :3], np.exp)
        rest = rest.astype(np.float32)
        both = p[:, 2] + rest[:, 5] * self.short[short_cell(packed(text, place, SHORT), SHORT_CELLS)]
        return np.log(p[:, 1] + rest[:, 4] * both) - np.log(p[:, 0] + rest[:, 3] * both)

    def measures(self, b: np.ndarray, off: np.ndarray, tried: tuple[float, ...]) -> np.ndarray:
        """For each share tried (rows) and document the mean difference of so many of its words, the greatest; 0 without
        words. A word is its bytes and the spaces after it."""
        n = len(off) - 1
        out = np.zeros((len(tried), n))
        if not len(b):
            return out
        text, place, owner = canonical(b, off)
        d = self.differences(text, place)
        starts = (text[place] != 32) & (text[place - 1] == 32)
        starts[np.flatnonzero(np.diff(owner, prepend=-1))] = True
        begins = np.flatnonzero(starts)
        word, of = np.add.reduceat(d, begins), owner[begins]
        words = np.bincount(of, minlength=n)
        sums = np.concatenate([[0.0], np.cumsum(word[np.lexsort([-word, of])])])
        first = np.cumsum(words) - words
        for row, share in zip(out, tried, strict=True):
            k = np.minimum(np.maximum(WORDS, np.ceil(share * words)).astype(np.int64), words)
            row[:] = (sums[first + k] - sums[first]) / np.maximum(1, k)
        return out

    def scores(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self.measures(b, off, (self.share,))[0] * self.line[1] + self.line[0])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(m: np.ndarray, y: np.ndarray, weights: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """(bias and slope of a logistic line by Newton steps, held small by a little ridge; its weighted loss)."""
    x = np.stack([np.ones(len(m)), m], 1)
    w = np.zeros(2)
    ridge = 0.5 * np.eye(2)
    for _ in range(steps):
        p = sigmoid(np.clip(x @ w, -30, 30))
        g = x.T @ (weights * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, float((weights * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum())


def best_cut(m: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(the cut from which on documents are toxic that has the least weight of wrong ones, halfway between two measures, the
    middle one if several do as well; that weight)."""
    order = np.argsort(m, kind="stable")
    m, y, weights = m[order], y[order], weights[order]
    missed = np.concatenate([[0.0], np.cumsum(weights * (y == 1))])
    wrong = np.concatenate([np.cumsum((weights * (y == 0))[::-1])[::-1], [0.0]])
    loss = missed + wrong
    apart = np.concatenate([[True], m[1:] > m[:-1], [True]])
    best = np.flatnonzero(apart & (loss <= loss[apart].min() + 1e-9))
    at = best[len(best) // 2]
    low, high = m[at - 1] if at else m[0] - 1, m[at] if at < len(m) else m[-1] + 1
    return float((low + high) / 2), float(loss[at])


def constant(share: float) -> Model:
    return Model(Rows([], 3), Rows([], 6), np.zeros(0, np.float32), SHARES[0], np.array([np.log(share / (1 - share)), 0.0]))


def tallied(counts: DataFrame, at: Column, bits: int, sums: list[Column]) -> np.ndarray:
    """The sums by cell (at): an array of 2**bits rows, which is all that the driver gets."""
    found = counts.groupBy(at.cast("int").alias("at")).agg(*(c.cast("float").alias(f"s{k}") for k, c in enumerate(sums))).toArrow()
    out = np.zeros((1 << bits, len(sums)), np.float32)
    at = found.column("at").to_numpy()
    for k in range(len(sums)):
        out[at, k] = found.column(f"s{k}").to_numpy()
    del found, at
    pa.default_memory_pool().release_unused()
    return out


def rows_of(counts: DataFrame, at: Column, bits: int, sums: list[Column], made: Callable[[np.ndarray], np.ndarray]) -> Rows:
    """What made gives of the sums by cell (at), of 2**bits cells. Tasks each take blocks of cells and pack them, so the driver
    gets the table compressed and never unpacks it."""
    names = [f"s{k}" for k in range(len(sums))]
    none = made(np.zeros((1 << BLOCK, len(sums)), np.float32))

    def pack(rows: pa.Table) -> pa.Table:
        found, cells = np.zeros((1 << BLOCK, len(names)), np.float32), rows.column("at").to_numpy()
        for k, name in enumerate(names):
            found[cells & ((1 << BLOCK) - 1), k] = rows.column(name).to_numpy()
        return pa.table({"block": pa.array([cells[0] >> BLOCK], pa.int32()), "raw": pa.array([packed_table(made(found))], pa.binary())})

    placed = counts.withColumn("at", at.cast("int")).withColumn("block", F.shiftright("at", BLOCK)).repartition("block")
    by_cell = placed.groupBy("block", "at").agg(*(c.cast("float").alias(n) for c, n in zip(sums, names, strict=True)))
    got = by_cell.groupBy("block").applyInArrow(pack, "block int, raw binary").toArrow()
    parts = dict(zip(got.column("block").to_pylist(), got.column("raw").to_pylist(), strict=True))
    empty = packed_table(none)
    return Rows([parts.get(k, empty) for k in range(1 << (bits - BLOCK))], none.shape[1])


def rests(total: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one over each sum of counts, or 0; the share that discounts leave for the shorter run)."""
    inverse = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
    return inverse, np.maximum(1 - left * inverse, 1e-6)


def log_rests(sums: np.ndarray) -> np.ndarray:
    """The logarithms of one over each sum of counts, and the shares that discounts leave, of rows of what discounts left
    and whole sums, three each."""
    inverse, rest = rests(sums[:, 3:], sums[:, :3])
    with np.errstate(divide="ignore"):
        return np.concatenate([np.log(inverse), rest], 1)


def short_model(ends: DataFrame, m: int) -> np.ndarray:
    """The probability of each cell of short runs, the shorter ones' being all alike. ends: short, and continuation counts c0
    and c1 by model."""
    count = F.col(f"c{m}")
    off = discount(*ends.agg(F.count_if(count == 1), F.count_if(count == 2)).first())
    left, whole = F.sum(F.greatest(count - F.lit(off), F.lit(0.0))), F.sum(count)
    short = F.col("short").cast("long")
    parent = short_cell(F.shiftright(short, 8), SHORT_BEFORE)
    cells = tallied(ends, short_cell(short, SHORT_CELLS), SHORT_CELLS, [left, F.max(parent)])
    before = tallied(ends, parent, SHORT_BEFORE, [left, whole])
    at = cells[:, 1].astype(np.int64)
    inverse, rest = rests(before[:, 1], before[:, 0])
    return (cells[:, 0] * inverse[at] + rest[at] / 256).astype(np.float32)


def models(counts: DataFrame) -> Iterator[Model]:
    """The model without the part left out, then the whole one, without lines. counts: as of run_counts."""
    columns = [F.col(f"n{k}") for k in range(4)]
    ends = counts.groupBy("short").agg(F.count_if(columns[0] + columns[2] > 0).alias("c0"), F.count("*").alias("c1"))
    for m in (0, 1):
        n = [counted(columns, 0, m), counted(columns, 1, m)]
        n.append(n[0] + n[1])
        few = np.array(counts.agg(*(F.count_if(x == k) for x in n for k in (1, 2))).first(), float).reshape(3, 2)
        left = [F.sum(F.greatest(x - F.lit(discount(*f)), F.lit(0.0))) for x, f in zip(n, few, strict=True)]
        cells = rows_of(counts, F.shiftrightunsigned("run", 64 - CELLS), CELLS, left, np.log1p)
        before = rows_of(counts, F.shiftrightunsigned("before", 64 - BEFORE), BEFORE, left + [F.sum(x) for x in n], log_rests)
        made = Model(cells, before, short_model(ends, m), SHARES[0], np.zeros(2))
        del cells, before
        yield made
        del made  # one model at a time


def measured(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(labels, measures by share) of the sample, in the order of the measures."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    names = [f"m{k}" for k in range(len(SHARES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in each_slice(batch.column("text"), SLICE):
                found = shared.value.measures(b, off, SHARES)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), *map(pa.array, found)], names=["y", *names])

    got = sample.select("y", "text").mapInArrow(measure, "y int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    shared.destroy()
    y, m = got.column("y").to_numpy().astype(float), np.array([got.column(n).to_numpy() for n in names])
    order = np.lexsort([y, *m])
    return y[order], m[:, order]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Class models of all labelled rows that learn (a condition on doc_id) allows, counted in Spark, and a line fitted
    on a bounded sample (2 * rows documents at most) of the part that the counts leave out for it. Equal texts of a
    label count once (those of one repeated doc_id each). Labels other than 0 and 1 and null ids are not looked at; of
    several labels of an id 1 counts. Null texts are empty. With one class alone, or none, every score is the share of
    label 1 (one half without labels)."""
    known = stored(labels_of(labels, label, learn), "known-labels")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = min(max(ones / n if n else 0.5, 1e-3), 1 - 1e-3)
    shared = F.broadcast(known) if n <= BROADCAST_ROWS else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).join(shared, "doc_id")
    one = stored(hashed.filter("size > 0").groupBy("y", "hash", "size").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y").distinct(), "one-of-equals")
    found = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return constant(share)
    left_out = lambda: F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(PARTS)) == 0
    one = F.broadcast(one) if sum(found.values()) <= BROADCAST_ROWS else one
    coded = texts.join(one, "doc_id").select("text", (2 * F.col("y") + left_out().cast("int")).cast("int").alias("code"))
    made = models(stored(run_counts(coded), "run-counts"))
    sample, _ = labelled_sample(docs, labels, label, learn & left_out(), rows)
    y, m = measured(sample, next(made))  # held by nothing else, so it is gone before the next is made
    if not len(y) or y.min() == y.max():
        return constant(share)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    cuts = [best_cut(x, y, np.where(y == 1, MISSED, 1.0) * weights) for x in m]
    lines = [logistic(x, y, weights) for x in m]
    best = min(range(len(SHARES)), key=lambda k: (cuts[k][1], lines[k][1]))
    slope = max(float(lines[best][0][1]), 1e-3)
    model = next(made)
    model.share, model.line = SHARES[best], np.array([-slope * cuts[best][0], slope])
    return model
