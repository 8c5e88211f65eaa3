"""Vectorised work on the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once; one longer row makes a slice of its own
SLICE_BYTES = 2 << 20
U = np.uint64


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of bounded size: (rows, bytes, row offsets); null texts are empty."""
    for batch in batches:
        col = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        if not len(col):
            continue
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(col):
            end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            end = min(max(end, at + 1), len(col))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def byte_codes(fold: bool) -> np.ndarray:
    """A random odd 64-bit code for each byte; with ``fold``, A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0xD6E8FEB86659FD93


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than \\x20 and \\x09-\\x0D,
    and the first word of each row (one more entry closes the last)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    closes[before] = inside[before]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.concatenate([[U(1)], np.full(longest - 1, U(_STEP))]), dtype=U)
    total = int(lengths.sum())
    heads = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(heads, lengths)
    source = place + np.repeat(starts, lengths)
    return mix(np.add.reduceat(codes[data[source]] * powers[place], heads) + lengths.astype(U))


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per array."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))
