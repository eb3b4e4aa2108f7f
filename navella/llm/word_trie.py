"""SentencePiece encoding and decoding of whole texts by a forward pass over a trie of marked words.

Texts are cut before each run of spaces, as no piece of the vocabulary goes on after another character into a
space. The distinct words of a slice, marked with the vocabulary's space sign, are sorted, so that words with a common
prefix follow each other and the walk over them is a depth-first walk of their trie: the forward states of the
common prefix are kept and only the rest is computed.

For a unigram model a state is Viterbi's: the best score of the prefix and the last piece of that best path. For a byte-pair
model a best sum of scores would not give the model's pieces, so there the state is the last piece of the prefix's
encoding. It exists once and is the longest piece that may follow the encoding before it; two pieces may follow each
other if merging their characters alone, best score first, ends in those two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from navella.llm.arrowtext import each_slice
from navella.llm.shared import with_fields
from navella.llm.tokens import Remembered, flattened, ranges, text_column

SPACE = "▁"
#: Words with their ids, and pairs of pieces, that a task remembers at most.
REMEMBERED_WORDS = 300_000
REMEMBERED_IDS = 2_000_000
REMEMBERED_PAIRS = 500_000
SLICE = 2 << 20
#: What a character outside a unigram vocabulary scores below its worst piece; a fixed value of the format.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BYTE_PAIR = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protocol-buffer wire format, in which model files are kept."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


def algorithm(raw: bytes) -> int:
    """A model file's kind: its trainer settings (field 2) hold it in their field 3; unigram where they don't."""
    return next((kind for number, settings in fields(raw) if number == 2 for k, kind in fields(settings) if k == 3), UNIGRAM)


class PieceModel:
    """Pieces, scores and byte ids of a SentencePiece model, unigram or byte-pair with byte fallback."""

    _of: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as source:
            raw = source.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.unigram = algorithm(raw) == UNIGRAM
        self.text: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte: dict[int, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        self.score = [0.0] * len(self.text)
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[i] = model.get_score(i)
                self.rank[piece] = (-self.score[i], i)
        self.id = {p: i for p, (_, i) in self.rank.items()}
        self.unknown_score = min((self.score[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        # the trie of the pieces: next node by node and character, and the piece that ends at a node
        self.next: dict[int, int] = {}
        self.ends_at = [-1]
        for piece, i in self.id.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                node = self.next.get(key, 0)
                if not node:
                    node = self.next[key] = len(self.ends_at)
                    self.ends_at.append(-1)
            self.ends_at[node] = i
        byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        plain = [byte_of[i] if i in byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_ends = np.cumsum([0, *map(len, plain)])
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.memory = Remembered(REMEMBERED_WORDS, REMEMBERED_IDS)

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def forget(self) -> None:
        """Drops what was remembered of words and pairs."""
        self.memory.forget()
        self.pairs.clear()

    def merged(self, text: str) -> list[str]:
        """The pieces left after merging characters, best score first and leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, piece: int) -> bool:
        if piece not in self.alone:
            self.alone[piece] = self.merged(self.text[piece]) == [self.text[piece]]
        return self.alone[piece]

    def _follows(self, a: int, b: int) -> bool:
        """Whether b may follow a, worked out anew."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        x, y = self.text[a], self.text[b]
        known = self.pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return known

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted words. states[i]: (last piece of the first i characters, where it begins, their score); a piece
        of -1 stands for a character outside the vocabulary, which becomes its bytes. open_at[i]: where pieces that
        could go on after the first i characters begin, and their trie nodes."""
        out = []
        states: list[tuple[int, int, float]] = [(-1, 0, 0.0)]
        open_at: list[list[tuple[int, int]]] = [[]]
        last, step, going = "", self._best if self.unigram else self._only, self.next.get
        for word in words:
            common, n = 0, min(len(last), len(word))
            while common < n and last[common] == word[common]:
                common += 1
            del states[common + 1 :], open_at[common + 1 :]
            for i in range(common, len(word)):
                c = ord(word[i])
                begun = [(j, node) for j, before in open_at[i] if (node := going(before << 21 | c))]
                if node := going(c):
                    begun.append((i, node))
                open_at.append(begun)
                states.append(step(states, begun, i))
            last = word
            found: list[int] = []
            i = len(word)
            while i:
                piece, j, _ = states[i]
                if piece < 0:
                    found += [self.byte[b] for b in reversed(word[j:i].encode())]
                else:
                    found.append(piece)
                i = j
            found.reverse()
            out.append(found)
        return out

    def _only(self, states: list, begun: list, i: int) -> tuple[int, int, float]:
        """The state of a byte-pair model: the longest piece that may follow what is before it."""
        ends_at, pairs = self.ends_at, self.pairs
        for j, node in begun:
            piece = ends_at[node]
            if piece >= 0:
                before = states[j][0]
                if before < 0:
                    fits = self._stands(piece)
                else:
                    fits = pairs.get(before << 20 | piece)
                    if fits is None:
                        fits = self._follows(before, piece)
                if fits:
                    return piece, j, 0.0
        return -1, i, 0.0

    def _best(self, states: list, begun: list, i: int) -> tuple[int, int, float]:
        """Viterbi's state: the last piece of the best path, of equal ones the longest (the library sums up whole texts in
        single precision, so of paths that tie it may take another). A character that is no piece by itself may stand
        alone for the penalty."""
        piece, start, score = -1, i, -np.inf
        single = False
        for j, node in begun:
            p = self.ends_at[node]
            if p >= 0:
                single |= j == i
                total = states[j][2] + self.score[p]
                if total > score:
                    piece, start, score = p, j, total
        if not single and states[i][2] + self.unknown_score > score:
            return -1, i, states[i][2] + self.unknown_score
        return piece, start, score

    def learn(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """New words (their UTF-8 bytes, a space being the mark), sorted, their ids and how many each has."""
        words = sorted(words)
        return words, *flattened(self.encode_sorted([w.decode("utf-8").replace(" ", SPACE) for w in words]))

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each). An empty text has none; any other begins with the mark."""
        n = len(off) - 1
        size = np.diff(off)
        shift = np.cumsum(np.concatenate([[0], size > 0]))
        put = np.full(len(b) + int(shift[-1]), 32, np.uint8)  # a space before each text
        put[np.arange(len(b)) + np.repeat(shift[1:], size)] = b
        off = off + shift
        at = np.zeros(len(put) + 1, bool)
        at[:-1] = put == 32
        at[1:-1] &= (put[:-1] != 32) & (put[:-1] != 0x81)  # nor after the last byte of the mark itself
        at[off] = True
        bounds = np.flatnonzero(at)
        array = pa.Array.from_buffers(pa.large_binary(), max(len(bounds) - 1, 0), [None, pa.py_buffer(bounds), pa.py_buffer(put)])
        coded = array.dictionary_encode()
        number = self.memory.numbers(coded.dictionary.to_pylist(), self.learn)
        number = number[coded.indices.to_numpy()] if n and len(number) else np.zeros(0, np.int64)
        ids, count = self.memory.gather(number)
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(bounds, off)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bytes before each) of ids and how many there are before each text: pieces and bytes put
        together, marks as spaces, without the space put before each text."""
        raw, size = ranges(self.plain, self.plain_ends[ids], self.plain_ends[ids + 1])
        off = np.concatenate([[0], np.cumsum(size)])[at]
        kept = np.ones(len(raw), bool)
        kept[off[:-1][np.diff(off) > 0]] = False
        return raw[kept], off - np.concatenate([[0], np.cumsum(np.diff(off) > 0)])


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with a column ids, array of int: the pieces of the whole text. A null text is empty and has none; so
    has an empty one. Repeated rows are encoded each; an empty table stays empty; a column ids of docs is replaced."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(model_path)
        try:
            for batch in batches:
                for i, j, b, off in each_slice(batch.column("text"), SLICE):
                    ids, at = model.encode(b, off)
                    part = batch.slice(i, j - i)
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])
        finally:
            model.forget()

    rows = docs.drop("ids").withColumn("text", text_column(docs))
    return rows.mapInArrow(encode, with_fields(rows.schema, "ids array<int>"))


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids before each row) of a column of lists; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with a column decoded: the text of each row's ids; null for null ids. A column decoded is replaced."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(model_path)
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                raw, off = model.decode(*lists_of(batch.column("ids")))
                null = batch.column("ids").is_null().to_pylist()
                raw = raw.tobytes()
                texts = [None if z else raw[x:y].decode("utf-8", "replace") for x, y, z in zip(off[:-1].tolist(), off[1:].tolist(), null, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(decode, with_fields(encoded.schema, "decoded string"))


def crc_of_each(ids: np.ndarray, at: np.ndarray) -> list[int]:
    """CRC-32 of each text's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def digests(encoded: DataFrame) -> DataFrame:
    """encoded with n_pieces and ids_crc32, of the ids as little-endian unsigned 32-bit integers; null ids count as none."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = lists_of(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at)), pa.array(crc_of_each(ids, at), pa.int64())], names=[*batch.schema.names, "n_pieces", "ids_crc32"])

    encoded = encoded.drop("n_pieces", "ids_crc32")
    return encoded.mapInArrow(digest, with_fields(encoded.schema, "n_pieces long, ids_crc32 long"))


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip (whether decoding the ids gives the text back, in which a mark reads as a
    space) of docs (doc_id, text), for those who want no ids: one pass in slices of about SLICE bytes. Null texts are
    empty; repeated rows count each; an empty table gives no row."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    mark = SPACE.encode()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(model_path)
        try:
            for batch in batches:
                for i, j, b, off in each_slice(batch.column("text"), SLICE):
                    ids, at = model.encode(b, off)
                    raw, ends = model.decode(ids, at)
                    raw, text = raw.tobytes(), b.tobytes()
                    bounds = zip(off[:-1].tolist(), off[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
                    same = [text[x:y].replace(mark, b" ") == raw[p:q] for x, y, p, q in bounds]
                    columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.array(crc_of_each(ids, at), pa.int64()), pa.array(same)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])
        finally:
            model.forget()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(check, schema)
