"""Array kernels over Arrow text columns, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55  # odd, hence invertible modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def word_starts(text: np.ndarray) -> np.ndarray:
    """Places at which words (runs without ASCII white space) start."""
    solid = ~SPACES[text]
    solid[1:] &= SPACES[text[:-1]]
    return np.flatnonzero(solid)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i up to n, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        made = []
        for b in (BASE, INVERSE):
            x = np.full(max(n + 1, CHUNK_BYTES + 1), b, U64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=U64))
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * BASE**i; any substring's hash follows from two of them."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * up[: len(symbols)], dtype=U64, out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place-independent hashes of the substrings [start, end)."""
    _, down = powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, of which there are len - k + 1."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    prefix = prefix_sums(symbols)
    _, down = powers(len(symbols))
    return mix((prefix[k:] - prefix[:n]) * down[:n])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by block-wise running minima."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, U64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
