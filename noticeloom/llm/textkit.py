"""Vectorised words and hashes over Arrow text columns.

A word is a run of bytes other than space and \\x09-\\x0D; UTF-8 keeps those bytes for themselves, so words of
bytes and words of code points are the same. Hashes are 64 bits wide. Bytes are taken eight at a time, each step
multiplied and mixed, so that patterns which make polynomials equal don't make these so; what is left, for texts that
aren't made against the constants, is the chance of 2 ** -64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18
LANES = 32
STEP = U(0x9E3779B97F4A7C15)
#: The bits of a lane that its first 0..8 bytes take.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = left * STEP + right
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data and from its end, with zeros beyond it."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each range: lane after lane, and blake2b for what is longer than LANES lanes."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * STEP + U(1))
    if not len(size):
        return out
    lanes = lanes_of(data)
    out = joined(out, lanes[start] & FIRST[np.minimum(size, 8)])
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    held, at = np.flatnonzero((size > 8) & (size <= 8 * LANES)), 8
    while len(held):  # ranges that have a byte at this lane
        left = size[held] - at
        out[held] = joined(out[held], lanes[start[held] + at] & FIRST[np.minimum(left, 8)])
        held, at = held[left > 8], at + 8
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; a longer row is a range of its own."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, min(end, n)
        row = end


class Words:
    """Words of rows at[0]..at[-1] of data: byte ranges start/end, and first[i]..first[i + 1] for row i.

    breaks: for each byte whether it stands between words.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE):
        self.base = int(at[0])
        self.data = data[self.base : int(at[-1])]
        self.at = at - self.base
        n = len(self.data)
        space = breaks[self.data]
        word = ~space
        begins, ends = word.copy(), word.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        cut = self.at[:-1][self.at[:-1] < n]
        begins[cut] = word[cut]
        cut = self.at[1:][(self.at[1:] > 0)] - 1
        ends[cut] = word[cut]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)

    def hashes(self, lower: bool = False, bare: bool = False) -> np.ndarray:
        """A hash of each word; lower: with A-Z as a-z; bare: without ASCII punctuation at either end, if a word is left."""
        data = LOWER[self.data] if lower else self.data
        start, end = without_punctuation(self.data, self.start, self.end) if bare else (self.start, self.end)
        return range_hashes(data, start, end)


def without_punctuation(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without ASCII punctuation at their ends; those of punctuation alone stay."""
    plain = np.r_[np.flatnonzero(~PUNCTUATION[data]), len(data)]
    first = plain[np.searchsorted(plain, start)]
    last = plain[np.maximum(np.searchsorted(plain, end) - 1, 0)] + 1
    whole = first < end
    return np.where(whole, first, start), np.where(whole, last, end)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width hashes, by those of runs half as long; the last width - 1 positions have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, held, power, size = None, 0, hashes, 1
    while True:
        if width & size:  # the run so far, then the next power of two
            out = power[:n] if out is None else joined(out[:n], power[held : held + n])
            held += size
        if held == width:
            return mix(out + U(width))
        power = joined(power[:-size], power[size:])
        size *= 2


def covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [i, i + width) for a true hit[i]."""
    step = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0

