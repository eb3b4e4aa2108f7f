"""Token ids of whole texts, by the public ``tokenizers`` vocabularies.

A text is cut where the vocabulary's own pre-tokenizer must cut as well, so the pieces' ids, put together, are
the text's ids. Distinct pieces of an Arrow batch are encoded once (a worker remembers a bounded number of
them), then ids are gathered for all documents with numpy.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from navella.llm.arrowtext import each_slice, lower_ascii

#: Pieces that a task remembers at most; beyond it only those stay that were asked for again.
REMEMBERED = 300_000
#: Ids that it remembers for them at most.
REMEMBERED_IDS = 4_000_000
SLICE = 1 << 20


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _letter(b: np.ndarray) -> np.ndarray:
    low = b | 32
    return (low >= 97) & (low <= 122)


def _before_mark(b: np.ndarray, at: np.ndarray) -> None:
    """Marks places between an ASCII letter and one of ``.,;:!?``: no pattern has both in one piece."""
    mark = (b == 46) | (b == 44) | (b == 59) | (b == 58) | (b == 33) | (b == 63)
    at[1:] |= mark[1:] & _letter(b[:-1])


def cuts_before_space(b: np.ndarray) -> np.ndarray:
    """Marks for vocabularies that drop white space: before a space or line feed, and before marks."""
    at = (b == 32) | (b == 10)
    _before_mark(b, at)
    return at


def cuts_byte_level(b: np.ndarray) -> np.ndarray:
    """Marks where byte-level pre-tokenizing surely cuts: before a single space, and after a single line feed,
    that stands between two characters that aren't white space, and before marks."""
    at = np.zeros(len(b), bool)
    if len(b) < 3:
        return at
    plain = (b > 32) & (b < 127)
    two = (b >= 0xC3) & (b <= 0xDF)  # lead bytes of characters that are no white space
    ends_ok = plain.copy()
    ends_ok[1:] |= two[:-1]
    starts_ok = plain | two
    at[1:-1] = (b[1:-1] == 32) & ends_ok[:-2] & starts_ok[2:]
    at[2:] |= (b[1:-1] == 10) & ends_ok[:-2] & starts_ok[2:]
    _before_mark(b, at)
    return at


#: Pieces that may be encoded in one text: no white space but a leading space, ASCII or U+00C0 to U+00FF, whose
#: number of bytes no normalizer changes.
_SIMPLE = re.compile(rb" ?(?:[!-~]|\xc3[\x80-\xbf])+").fullmatch
_TOGETHER = 4096


#: How texts may be cut for each vocabulary, and the size of its ids.
CUTS = {"byte_bpe_50k.json": cuts_byte_level, "word_bpe_49k.json": cuts_before_space}


def ranges(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts of x from first to last, one after the other, their sizes)."""
    size = last - first
    before = np.cumsum(size) - size
    return x[np.repeat(first - before, size) + np.arange(int(size.sum()))], size


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all lists, the lists' sizes)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size


class Remembered:
    """The ids of pieces met before, in two arrays, with a bound on both pieces and ids."""

    def __init__(self, most: int, most_ids: int):
        self.most, self.most_ids = most, most_ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 12, np.uint32)
        self.ends = np.zeros(1 << 10, np.int64)  # of the known pieces' ids; the first is the start
        self.used = np.zeros(1 << 10, np.int32)
        self.count = 0

    def _shed(self) -> None:
        """Keeps the pieces asked for more than once, the most asked for, up to half of what may be kept."""
        again = np.flatnonzero(self.used[: self.count] > 1)
        again = np.sort(again[np.argsort(-self.used[again], kind="stable")[: self.most // 2]])
        size = self.ends[again + 1] - self.ends[again]
        if size.sum() > self.most_ids // 2:
            again = again[:0]
        names = list(self.known)  # in the order of their numbers
        flat, sizes = self.gather(again)
        self.forget()
        self._add([names[k] for k in again.tolist()], flat, sizes)

    def _add(self, pieces: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        at = int(self.ends[self.count])
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(pieces) + 1 > len(self.ends):
            self.ends, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.used))
        self.ids[at : at + len(flat)] = flat
        self.ends[self.count + 1 : self.count + 1 + len(pieces)] = at + np.cumsum(sizes)
        self.known.update(zip(pieces, range(self.count, self.count + len(pieces)), strict=True))
        self.count += len(pieces)

    def numbers(self, pieces: list[bytes], learn) -> np.ndarray:
        """The number of each of some distinct pieces. learn: from new pieces to (pieces, their ids, how many each has)."""
        if self.count + len(pieces) > self.most or self.ends[self.count] > self.most_ids:
            self._shed()
        new = [p for p in pieces if p not in self.known]
        if new:
            self._add(*learn(new))
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.used[number] += 1
        return number

    def sizes(self, number: np.ndarray) -> np.ndarray:
        return self.ends[number + 1] - self.ends[number]

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, how many each has)."""
        return ranges(self.ids, self.ends[number], self.ends[number + 1])


class TextEncoder:
    """Encodes Arrow columns of whole texts. What it remembers of pieces is dropped at the end of a task by forget."""

    _of: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cuts = CUTS[os.path.basename(path)]
        self.drops_space = self.cuts is cuts_before_space
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>") if self.drops_space else token)
        self.memory = Remembered(REMEMBERED, REMEMBERED_IDS)

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        """The worker's own encoder of a vocabulary file."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def forget(self) -> None:
        self.memory.forget()

    def _alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in self.tokenizer.encode_batch([p.decode("utf-8") for p in pieces], add_special_tokens=False)])

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple pieces, encoded in one text and parted by the number of bytes of each id."""
        feed = 0 if self.drops_space else 1
        spaced = [p if p[0] == 32 else b"\n" + p for p in pieces]
        own = np.fromiter((len(p) - (p[0] == 32) * (1 - feed) for p in pieces), np.int64, len(pieces))
        lead = np.fromiter((feed * (p[0] != 32) for p in pieces), np.int64, len(pieces))
        ids = np.array(self.tokenizer.encode(b"".join(spaced).decode("utf-8"), add_special_tokens=False).ids, np.uint32)
        width = np.concatenate([[0], np.cumsum(self.width[ids])])
        stop = np.cumsum(own + lead)
        first, last = np.searchsorted(width, stop - own), np.searchsorted(width, stop)
        if width[-1] != stop[-1] or (width[first] != stop - own).any() or (width[last] != stop).any():
            return self._alone(pieces)
        return ranges(ids, first, last)

    def _learn(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        simple, odd = [], []
        for p in pieces:
            (simple if _SIMPLE(p) else odd).append(p)
        found = [self._together(simple[k : k + _TOGETHER]) for k in range(0, len(simple), _TOGETHER)] + [self._alone(odd)]
        return simple + odd, *(np.concatenate(x) for x in zip(*found, strict=True))

    def pieces(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece bounds in b, number of known piece at each place, pieces before each document)."""
        at = np.append(self.cuts(b), True)
        at[off] = True
        bounds = np.flatnonzero(at)
        if self.drops_space:  # its normalizer lower-cases and takes all white space alike
            b = lower_ascii(b)
            b[b == 10] = 32
        array = pa.Array.from_buffers(pa.large_binary(), max(len(bounds) - 1, 0), [None, pa.py_buffer(bounds), pa.py_buffer(b)])
        coded = array.dictionary_encode()
        number = self.memory.numbers(coded.dictionary.to_pylist(), self._learn)
        return bounds, number[coded.indices.to_numpy()] if len(number) else np.zeros(0, np.int64), np.searchsorted(bounds, off)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice of documents: (first, end, ids of all of them, ids before each of them)."""
        for i, j, b, off in each_slice(column, SLICE):
            if not len(b):
                yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            _, number, at = self.pieces(b, off)
            ids, size = self.memory.gather(number)
            yield i, j, ids, np.concatenate([[0], np.cumsum(size)])[at]

    def count_ids(self, raw: bytes) -> int:
        """Number of ids of a stretch of text that begins and ends where its text is cut."""
        if not raw:
            return 0
        b = np.frombuffer(raw, np.uint8)
        _, number, _ = self.pieces(b, np.array([0, len(b)]))
        return int(self.memory.sizes(number).sum())

    def encode_each(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for _, _, ids, at in self.encode(column):
            out += [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return out


def text_column(df, name: str = "text"):
    """The column as string, null as empty."""
    from pyspark.sql import functions as F

    return F.coalesce(F.col(name).cast("string"), F.lit(""))


