"""Arrow helpers shared by the operators: text columns as byte buffers, words, bounded slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.sources import shared

SLICE_BYTES = 8 << 20


def byte_class(pattern_breaks: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that belongs to a word; the ranges given break words. Bytes of 128 and more never do."""
    table = np.ones(256, bool)
    for lo, hi in pattern_breaks:
        table[lo:hi + 1] = False
    return table


#: Words `[^\x20\x09-\x0D]+` and words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
BLANK_WORDS = byte_class([(0x09, 0x0D), (0x20, 0x20)])
PLAIN_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the int64 offsets of the rows in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The array whose row i is data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words(column: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column one after another, and the int64 word offsets of its rows."""
    flat, rows, _ = placed(column, word_bytes, lower)
    return flat, rows


def placed(column: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``words``, with the byte at which each word starts."""
    data, rows = buffers(column)
    if lower:
        data = LOWER[data]
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(rows), np.int64), np.zeros(0, np.int64)
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    return strings(data[inside], offsets), np.searchsorted(start, rows), start


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of values in order of first occurrence, and the distinct values."""
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


LONG_WORD = 64  # bytes from which a word is hashed by words of eight


def hash_words(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value: column by column on the bytes, long values by ``hash_words_long``."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    n = np.diff(offsets)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    many = np.flatnonzero(n > LONG_WORD)
    order = np.argsort(-n, kind="stable")[len(many):]  # rows that still have a byte at a position come first
    begin, left, acc = offsets[:-1][order], n[order], out[order]
    live = len(order)
    for at in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -at, side="left"))
        part = acc[:live]
        part ^= data[begin[:live] + at]
        part *= np.uint64(0x100000001B3)
        part ^= part >> np.uint64(29)
    out[order] = acc
    out = mix(out)
    if len(many):
        out[many] = hash_words_long(*buffers_of(values.take(pa.array(many))))
    return out


def buffers_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array that starts at its buffers' start."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def hash_words_long(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, long ones included: mixed words of eight, by place, added up."""
    size = np.diff(rows)
    count = -(-size // 8)
    of = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = rows[:-1][of] + 8 * at
    view = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    spare = np.maximum(0, 8 - (rows[1:][of] - start)).astype(np.uint64) * np.uint64(8)
    word = view[start] << spare
    value = mix(word ^ mix(at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    ends = np.cumsum(count)
    return mix(total[ends] - total[ends - count] + size.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, one row at least, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def spread(each: list, codes: np.ndarray, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """For values given by code, each a sequence: all items in order of ``codes``, and the offset of each code's items."""
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((i for e in each for i in e), kind, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    n = sizes[codes]
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(begin[codes] - upto[:-1], n) + np.arange(upto[-1])], upto


def ended(values: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with one more value after each."""
    k = len(offsets) - 1
    out = np.empty(len(values) + k, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(k), np.diff(offsets))] = values
    out[offsets[1:] + np.arange(k)] = end
    return out, offsets + np.arange(k + 1)


def light(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The frame as a table, to be broadcast if it is counted to have few rows (of fixed width), else to be joined by a shuffle."""
    table = shared.materialize(df)
    return F.broadcast(table) if table.count() <= rows else table


def lowest(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """At most ``n`` rows of ``df``: those whose key has the least hash.

    Of the ``rows`` in all, only the share of hashes that holds about 4 n of them is sorted, so that tasks do not
    each send n rows; from some dozens on, n of these are as good as sure to be there.
    """
    h = F.xxhash64(key)
    share = 4 * n / max(1, rows)
    some = df if share >= 1 or n < 50 else df.where(h < int(share * (1 << 64)) - (1 << 63))
    return some.orderBy(h, key).limit(n)


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_text(df: DataFrame, text: str, added: T.StructType, fn: Callable[[pa.Array], list[pa.Array]],
             keep: list[str] | None = None, limit: int = SLICE_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """Append columns computed from a text column, slice by slice of about ``limit`` bytes; ``after`` runs at a task's end.

    A column of an added name is replaced. ``keep`` names the columns of ``df`` to return (all by default).
    """
    new = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    read = list(dict.fromkeys([*kept, text]))
    schema = T.StructType([*(df.schema[c] for c in kept), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, limit):
            made = fn(part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made],
                                             names=[*kept, *(f.name for f in added)])
        if after:
            after()

    return df.select(*(df[f"`{c}`"] for c in read)).mapInArrow(run, schema)
