"""Array kernels over Arrow text buffers: no Python object is made for a document or a word.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, after lower-casing by
Unicode rules; everything else separates. SQL twin: split lower(text) at [^a-z0-9\\x80-\\U0010FFFF]+.
Null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[U64(1), np.full(size - 1, p, U64)]) for p in (_P, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of the batches with about so many bytes of text (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            stop = min(stop, start + 20_000)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each of its texts starts, with the end as the last; nulls are empty."""
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32, len(text) + 1, text.offset * (8 if wide else 4)).astype(np.int64)
    data = text.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def lower(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(text)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word with the number of words as the last."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ((data | 32) - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data > 127)
    opens = inside[1:] > inside[:-1]
    closes = inside[:-1] > inside[1:]
    within = offsets[inside[offsets] & inside[offsets + 1]]  # one text ends and the next begins without a separator
    opens[within] = closes[within] = True
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of a polynomial."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        body = sums[1:]
        body[:] = data
        body += U64(1)
        body *= power[:-1]
        np.cumsum(body, out=body)
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word, and the index of each text's first word with the number of words as the last."""
    data, offsets = buffers(lower(text))
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def owners(first: np.ndarray) -> np.ndarray:
    """For each item of a ragged array, the row that it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words within a text; a shorter text with words has one, of all it has."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    if not len(words):
        return np.zeros(0, U64), out_first
    power, inverse = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * power[:-1], out=sums[1:])
        row = owners(out_first)
        start = np.arange(out_first[-1]) - out_first[row] + first[row]
        end = np.minimum(start + width, first[row + 1])
        return mix((sums[end] - sums[start]) * inverse[start]), out_first


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the sorted keys, 0 for what isn't among them; a table by the top bits answers most misses."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    bits = max(8, min(20, int(len(keys)).bit_length() + 3))
    shift = U64(64 - bits)
    low = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << shift)
    some = np.zeros(1 << bits, bool)
    some[(keys >> shift).astype(np.int64)] = True
    out = np.zeros(len(wanted), values.dtype)
    top = (wanted >> shift).astype(np.int64)
    hit = np.flatnonzero(some[top])
    sought = wanted[hit]
    at = low[top[hit]]
    while len(hit):
        found = keys[np.minimum(at, len(keys) - 1)]
        same = found == sought
        out[hit[same]] = values[at[same]]
        more = (found < sought) & (at + 1 < len(keys))
        hit, sought, at = hit[more], sought[more], at[more] + 1
    return out


def binary_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row's part of an array."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(first) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def ragged(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of binary_rows: all values, and where each row's start."""
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    size = np.dtype(dtype).itemsize
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype, (offsets[-1] - offsets[0]) // size, offsets[0]), (offsets - offsets[0]) // size


def to_batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
