"""Secrets in texts: three patterns, and Markov models of characters for what no pattern names.

Each text is read once. The values that the patterns match are labelled samples of random strings; of the other long runs of
identifier characters those made of words, whole or in camel case or joined by marks, are samples of ordinary identifiers,
and what is neither stays unlabelled, as secrets of unknown forms are among it. Two models of characters given the two before them are counted on
both, over all rows; a run is marked if the log-likelihood ratio of random to ordinary, per character, is over a cut that
is chosen on samples left out of the counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navella.llm.shared import stored
from navella.llm.tokens import text_column

# The patterns, and the least characters of a match (assign: of its second group).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
#: AKIA[A-Z0-9]+ of 18 characters and [0-9a-f]+ of 16 or more: their runs end alike with the length asked for here.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs that the models judge: shorter ones tell too little.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Words of three letters or more, in one case or capitalised, in a row or with marks between.
ORDINARY = re.compile(r"(?:[A-Z][a-z]{2,}+|[a-z]{3,}+|[A-Z]{3,}+|[+/_=-])++")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N = len(SYMBOLS)
#: Number of each symbol, of any other byte (N - 1 too) and of a run's start, N.
_CODE = np.full(256, N - 1, np.int64)
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(N)
CELLS = (N + 1) * (N + 1) * N
#: Pseudo-counts by which each order leans on the next shorter one.
LEAN = 8.0
#: Share of the random model given to all symbols alike: secrets may be of alphabets that no sample has.
OPEN = 0.1
#: One sample of so many is left out of the counts for the choice of the cut.
HELD = 5
#: What an ordinary identifier that is marked costs, in missed random strings, both in shares of their kind.
COST = 10.0
BINS, RANGE = 800, 20.0
#: Where several cuts are best alike, how far up from the lowest to the highest of them the cut is.
UP = 1 / 3


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], set[str]]:
    """(kind's number, start, end) of the patterns' matches in order of start and kind, and their values."""
    found, values = [], set()
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            found.append((m.start(), 0, m.end()))
            values.add(m.group(2))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            found.append((m.start(), kind, m.end()))
            values.add(m.group())
    return [(k, a, b) for a, k, b in sorted(found)], values


def other_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, run) of identifier runs that no match of a pattern touches."""
    found, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        while k < len(base) and base[k][1] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            found.append((m.start(), m.end(), m.group()))
    return found


def cells(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cell (two characters before, character) of every character of the values, and the value each is of."""
    raw = [v.encode() for v in values]
    sizes = np.array([len(r) for r in raw], np.int64)
    joined = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(joined)) - np.repeat(starts, sizes)
    back = [np.where(place >= k, np.roll(joined, k), N) for k in (1, 2)]
    return (back[1] * (N + 1) + back[0]) * N + joined, np.repeat(np.arange(len(raw)), sizes)


def held_out(values: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(v.encode()) % HELD == 0 for v in values], bool)


def shares(counts: np.ndarray) -> np.ndarray:
    """Share of each character given the two before it, each order leaning on the shorter one, the shortest on all alike."""
    c3 = counts.reshape(N + 1, N + 1, N).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + LEAN / N) / (c1.sum() + LEAN)
    p2 = (c2 + LEAN * p1) / (c2.sum(-1, keepdims=True) + LEAN)
    return (c3 + LEAN * p2) / (c3.sum(-1, keepdims=True) + LEAN)


@dataclass
class Model:
    """The log ratio of every cell, and the ratio per character from which a run is marked."""

    ratio: np.ndarray
    cut: float = np.inf

    def scores(self, values: list[str]) -> np.ndarray:
        cell, owner = cells(values)
        total = np.bincount(owner, self.ratio[cell], len(values))
        return total / np.maximum(1, np.bincount(owner, minlength=len(values)))


def best_cut(random: np.ndarray, ordinary: np.ndarray) -> float:
    """The edge of the bins at which the missed share of random samples and COST times the marked share of ordinary ones are
    least; if several are, that UP of the way from the lowest. Without samples of both kinds nothing is marked."""
    if not random.sum() or not ordinary.sum():
        return np.inf
    missed = np.concatenate([[0], np.cumsum(random)]) / random.sum()
    marked = 1 - np.concatenate([[0], np.cumsum(ordinary)]) / ordinary.sum()
    loss = missed + COST * marked
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(best[int(len(best) * UP)]) * 2 * RANGE / BINS - RANGE


FOUND = "doc_id long, base array<struct<kind:int,start:long,end:long>>, random array<string>, runs array<struct<start:long,end:long,value:string,ordinary:boolean>>"


def found_in(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text) its base spans, the values in them and the other runs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], FOUND).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                base, values = base_spans(text)
                runs = [{"start": a, "end": b, "value": v, "ordinary": bool(ORDINARY.fullmatch(v))} for a, b, v in other_runs(text, base)]
                rows.append({"doc_id": doc_id, "base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "random": sorted(values), "runs": runs})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return stored(docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(read, FOUND), "secret-runs")


def _tally(samples: DataFrame, size: int, places) -> np.ndarray:
    """Counts by label (1 random, 0 ordinary) and place, of which there are size; each task sends its sums only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            for label, column in ((1, "random"), (0, "ordinary")):
                values = batch[column].flatten().to_pylist()
                for k in range(0, len(values), 10_000):
                    part = values[k : k + 10_000]
                    sums[label] += np.bincount(places(part), minlength=size)
        label, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[label, place], pa.int64())], ["label", "place", "n"])

    sums = np.zeros((2, size), np.int64)  # at most two rows for each place come to the driver, whatever the table's size
    for r in samples.mapInArrow(add, "label int, place int, n long").groupBy("label", "place").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        sums[r["label"], r["place"]] = r["n"]
    return sums


def fit(samples: DataFrame) -> Model:
    """The models of labelled samples (random array<string>, ordinary array<string>; null and empty arrays have none), all counted
    but one in HELD, on which the cut is chosen."""

    def counted(values: list[str]) -> np.ndarray:
        cell, owner = cells(values)
        return cell[~held_out(values)[owner]] if len(cell) else cell

    random, ordinary = _tally(samples, CELLS, counted)[::-1]
    ratio = np.log((1 - OPEN) * shares(random) + OPEN / N) - np.log(shares(ordinary))
    model = Model(ratio.reshape(-1).astype(np.float32))

    def binned(values: list[str]) -> np.ndarray:
        score = model.scores(values)[held_out(values)] if values else np.zeros(0)
        return np.clip((score + RANGE) * BINS / (2 * RANGE), 0, BINS - 1).astype(np.int64)

    random, ordinary = _tally(samples, BINS, binned)[::-1]
    return Model(model.ratio, best_cut(random, ordinary))


SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): base, the spans of the patterns, and spans, these and those of runs that the
    models mark, each by start, then by kind in the order of KINDS; places count code points, ends are exclusive. Null
    and empty texts have none; repeated rows are scanned each. A table without rows, or without samples of both kinds,
    has no markov spans. Further columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    found = found_in(docs)
    ordinary = F.transform(F.filter("runs", lambda r: r["ordinary"]), lambda r: r["value"])
    model = fit(found.select("random", ordinary.alias("ordinary")))
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], SPANS).schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            each = batch.select(["doc_id", "base", "runs"]).to_pylist()
            values = [x["value"] for r in each for x in r["runs"]]
            over, at, rows = model.scores(values) >= model.cut if values else [], 0, []
            for r in each:
                base = [(x["kind"], x["start"], x["end"]) for x in r["base"]]
                more = [(3, x["start"], x["end"]) for k, x in enumerate(r["runs"], at) if over[k]]
                at += len(r["runs"])
                rows.append({"doc_id": r["doc_id"], "base": named(base), "spans": named(sorted(base + more, key=lambda s: (s[1], s[0])))})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return found.mapInArrow(mark, SPANS)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
