"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch is cut into pieces of whole documents of about PIECE_BYTES, so that the arrays stay small
whatever the size of the Arrow batch; a longer document is a piece of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
# Of order 2**62 modulo 2**64 and odd, so that powers have inverses.
_BASE = 0xD1342543DE82EF95

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of words that are split at ASCII white space only.
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
#: Bytes of words made of ASCII letters, digits and anything beyond ASCII.
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass
class Texts:
    """Texts of some rows end to end: row i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def __getitem__(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0]:at[-1]], at - at[0])


def pieces(batch: pa.RecordBatch, column: str = "text",
           limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of whole rows with at most `limit` bytes of text, or one row."""
    texts = texts_of(batch.column(column))
    start, n = 0, len(texts)
    while start < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        # Many empty rows weigh nothing; bound their number too.
        end = min(end, start + 20_000)
        a, b = texts.offsets[start], texts.offsets[end]
        yield (batch.slice(start, end - start),
               Texts(texts.data[a:b], texts.offsets[start:end + 1] - a))
        start = end


@dataclass
class Words:
    """Words of a piece: bytes starts[i]:ends[i]; row r has words first[r]:first[r + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: Texts, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes that do not cross rows."""
    inside = is_word[texts.data]
    n = len(inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    edges = texts.offsets[texts.offsets < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[texts.offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    return values[LOWER] if fold_case else values


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow_powers(n: int) -> None:
    global _powers, _inverses
    if len(_powers) >= n:
        return
    size = max(n, 2 * PIECE_BYTES)
    inverse = pow(_BASE, -1, 1 << 64)
    for name, base in (("_powers", _BASE), ("_inverses", inverse)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        globals()[name] = np.multiply.accumulate(steps)


class Hasher:
    """64-bit hashes of any byte ranges of a piece, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, fold_case: bool):
        n = len(data)
        _grow_powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(fold_case)[data] * _powers[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * _inverses[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_ODD))

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all ranges of one size, by start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * _inverses[:n])


def word_hashes(texts: Texts, words: Words, fold_case: bool = True) -> np.ndarray:
    return Hasher(texts.data, fold_case).ranges(words.starts, words.ends)


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words, by first word; rows are not told apart."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + hashes[i:i + n]
    return mix(total + np.uint64(size))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], zero for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs Spark stores."""
    return values.view(np.int64)


def normalised(texts: Texts, words: Words) -> tuple[bytes, np.ndarray]:
    """Words in lower case with one space between them, a line end after a row's last one.

    Also gives where each word begins, so that places map back to the words of the texts.
    """
    sizes = words.ends - words.starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    source = np.repeat(words.starts - begins, sizes + 1) + np.arange(total)
    out = LOWER[texts.data[np.minimum(source, max(len(texts.data) - 1, 0))]] if total else \
        np.zeros(0, np.uint8)
    gaps = begins + sizes
    out[gaps] = 0x20
    filled = np.flatnonzero(words.counts)
    out[gaps[words.first[filled + 1] - 1]] = 0x0A
    return out.tobytes(), begins
