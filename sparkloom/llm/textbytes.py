"""Vectorised work on the UTF-8 bytes of a column of texts: words, hashes, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes, each of which takes some hundred of memory meanwhile; one longer text is a run of its own.
RUN_BYTES = 1 << 19

U64 = np.uint64
#: Random odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls while small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(19, n.bit_length())
        have = np.full(size, base & (2**64 - 1), dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 16 * RUN_BYTES:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and the len+1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about `most` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of code(data[k]) * BASE**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    inverse = powers(BASE_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes; none crosses from a text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[inner] = w[inner]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[inner - 1] = w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words that follow one another, for every start that has n (texts' ends are the caller's matter)."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.full(len(words) - n + 1, U64(n))
    for j in range(n):
        out *= U64(BASE)
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
