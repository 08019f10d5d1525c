"""Words of many texts at once, as numpy arrays over Arrow's buffers.

A word is a run of bytes other than space and U+0009 to U+000D. Hashes are 64 bits wide:
a polynomial over a random table of the bytes, mixed. Equal words have equal hashes in every
task; what must not rest on hashes alone is compared again by those who use them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODES = _BYTE_CODES[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
# Bytes that are hashed at once, which bounds the arrays made for it whatever a text's length.
BLOCK = 1 << 18
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all positions, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; the table kept for them is the longest asked for."""
    if len(_powers[kind]) < n:
        row = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        row[0] = 1
        _powers[kind] = np.multiply.accumulate(row)
    return _powers[kind][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and, for each row and one more, where it begins. Null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


@dataclass
class Words:
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row and one more: the number of its first word
    codes: np.ndarray  # a hash of each word

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def row_end(self) -> np.ndarray:
        return np.repeat(self.first[1:], np.diff(self.first))


def words(column: pa.Array, lower: bool = False) -> Words:
    data, at = text_bytes(column)
    n = len(data)
    dark = ~IS_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[1:] = ~dark[:-1]
    before[:1] = True
    after = np.empty(n, bool)
    after[:-1] = ~dark[1:]
    after[-1:] = True
    begin = np.flatnonzero(dark & (before | edge[:-1]))
    end = np.flatnonzero(dark & (after | edge[1:])) + 1
    return Words(data, begin, end, np.searchsorted(begin, at), span_codes(data, begin, end, lower))


def span_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each span of bytes. Spans come in order and do not overlap."""
    codes, sums = _LOWER_CODES if lower else _BYTE_CODES, np.zeros(len(begin), np.uint64)
    size = end - begin
    # Spans go together whose bytes fit one block; a longer one goes alone, block by block.
    a = 0
    while a < len(begin):
        b = max(int(np.searchsorted(end, begin[a] + BLOCK, "right")), a + 1)
        if size[a] > BLOCK:
            sums[a], b = _long_sum(codes, data[begin[a] : end[a]]), a + 1
        else:
            sums[a:b] = _block_sums(codes, data[begin[a] : end[b - 1]], begin[a:b] - begin[a], size[a:b])
        a = b
    return mix(sums + size.astype(np.uint64) * _STEP)


def _block_sums(codes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _power("up", _BASE, BLOCK)[: len(data)], out=sums[1:])
    return (sums[begin + size] - sums[begin]) * _power("down", _INVERSE, BLOCK)[begin]


def _long_sum(codes: np.ndarray, data: np.ndarray) -> np.uint64:
    powers, total = _power("up", _BASE, BLOCK), 0
    for at in range(0, len(data), BLOCK):
        part = codes[data[at : at + BLOCK]]
        total += int((part * powers[: len(part)]).sum()) * pow(int(_BASE), at, 2**64)
    return np.uint64(total % 2**64)


def window_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; the last n - 1 places have none. Rows are not minded."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        total = total * _BASE + codes[j : len(codes) - n + 1 + j]
    return mix(total + np.uint64(n))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
