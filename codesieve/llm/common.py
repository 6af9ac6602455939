"""Helpers shared by the operators: tables in the cluster's shared folder and word arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codesieve.session import materialize, ship_package

# A word everywhere in this package unless an operator says otherwise.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with so many underscores behind it that no taken name is equal (in any case)."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, a lost executor
    recomputes nothing, and later joins know the size from the files."""
    return materialize(df, name)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty.

    offsets has one entry more than rows and starts at 0 for the slice given.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, max_bytes: int = 2 << 20):
    """Row ranges [lo, hi) of at most ``max_bytes`` each (a longer single row is a range of its own)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1, lo + 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def small_batches(batches, at: int, max_bytes: int = 2 << 20):
    """Record batches cut into slices of at most ``max_bytes`` of the string column ``at`` (a longer single row is one of
    its own), so that what a worker makes of them at a time doesn't grow with its batches."""
    for b in batches:
        if not b.num_rows:
            yield b
        _, offsets = utf8_buffer(b.column(at))
        for lo, hi in row_chunks(offsets, max_bytes):
            yield b.slice(lo, hi - lo)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_WIDTH = 64
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, _WIDTH * 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row) of all white-space separated words; none crosses a row."""
    n = len(raw)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
    edge = np.flatnonzero(change)
    if len(joined):  # a row ends and the next begins inside what looks like one word
        edge = np.sort(np.concatenate([edge, joined, joined]))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, which depends on the word's own bytes alone, not on the words beside it.

    Words are read in pieces of 8 bytes, each mixed with the hash of those before it; words beyond 64 bytes, which may be
    of any length, byte by byte.
    """
    length = ends - starts
    out = length.astype(np.uint64) * _ODD
    if not len(starts):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    pieces = np.ascontiguousarray(np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,)))  # the 8 bytes from each place on
    out = mix64(out ^ (pieces[starts] & _LOW_BYTES[np.minimum(length, 8)]))
    for lo in range(8, min(int(length.max()), _WIDTH), 8):
        more = np.flatnonzero(length > lo)
        out[more] = mix64(out[more] ^ (pieces[starts[more] + lo] & _LOW_BYTES[np.minimum(length[more] - lo, 8)]))
    far = np.flatnonzero(length > _WIDTH)
    if len(far):
        out[far] = _long_hashes(raw, starts[far], length[far])
    return out


def _long_hashes(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of long words: a random number per (place, byte), summed, then mixed; places beyond 64 are folded in 64-byte
    pieces with a place factor."""
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    value = _RANDOM[(place & (_WIDTH - 1)) * 256 + raw[place + np.repeat(starts, length)]]
    value = mix64(value + (place >> 6).astype(np.uint64) * _ODD)
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64) * _ODD)
