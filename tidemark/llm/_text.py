"""Words and their hashes from Arrow string columns, a block of bytes at a time.

A batch is cut into blocks of whole rows of about BLOCK bytes, so that the eight-byte arrays made from a
block stay small whatever the batch size. Words are compared by 64-bit hashes: two different words share one
with a probability of about 5e-20.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import kept

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1342543DE82EF95 | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of the contracts on text: everything but ASCII white space.
NOT_SPACE = ~SPACE
#: Words of the benchmark contract, after lower-casing: ASCII letters and digits, and all bytes over 0x7F.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict = {}
kept(_powers.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = tuple(out)
        if size <= 2 * BLOCK:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(column, size: int = BLOCK):
    """(first row, row after the last, bytes, offsets from 0) of each block of whole rows."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, rows)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class Words:
    """start, end: byte positions in the block. doc: row in the block. first: index of each row's first word, and the end. hash: of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = False):
        data = LOWER[data] if lower else data
        n, rows = len(data), len(offsets) - 1
        is_word = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = is_word[:-1]
            after[:-1] = is_word[1:]
        self.data = data
        self.start = np.flatnonzero(is_word & (~before | edge[:n]))
        self.end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self.count = np.diff(self.first)
        up, down = powers(_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self._total, self._down = total, down[self.start]
        self.hash = mix((total[self.end] - total[self.start]) * self._down)

    def heads(self, n: int) -> np.ndarray:
        """The hash of the first n bytes of each word, or of all of a shorter one."""
        return mix((self._total[np.minimum(self.start + n, self.end)] - self._total[self.start]) * self._down + np.uint64(n))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of each n consecutive words, for every start with n words left in the block (rows not heeded)."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, np.uint64)
    up, down = powers((_GRAM + 4 * salt * 0x2545F4914F6CDD1D) % (1 << 64), m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(hashes * up[:m], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: m - n + 1] + np.uint64(n))


def gram_starts(words: Words, n: int) -> np.ndarray:
    """True where n consecutive words lie in one row; as long as grams()."""
    return words.doc[: max(0, len(words.doc) - n + 1)] == words.doc[n - 1 :]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane, which compresses well."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes()


def unpack_sorted(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def unpack(blob: bytes, kind) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
