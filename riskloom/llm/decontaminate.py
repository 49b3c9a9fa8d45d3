"""Benchmark passages in documents, found by Wu-Manber search over words.

A pattern is a window of ``size`` consecutive words of an item (a shorter item is one window). For the
patterns of one length, a shift table tells for each block of two words how far the search may jump; a
block that ends patterns leads to a bucket of suffixes, and comparing the words confirms an occurrence.

The tables are built by tasks from shares of the items and lie in the shared folder. Items of up to
``share_bytes`` of text make one share; a larger benchmark makes more shares, and each slice of documents is then
searched with one share after another, so a task never holds more than one.
"""

from __future__ import annotations

import pickle
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks, store
from riskloom.sources import shared

SHARE_BYTES = 8 << 20
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]), False)),
    T.StructField("items", T.ArrayType(T.LongType(), False)),
])


class Lengths:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], set[int]], base: int):
        self.length, self.block, self.base = length, min(2, length), base
        self.jump = length - self.block + 1  # a block that no pattern holds
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for words, items in patterns.items():
            for at in range(self.block - 1, length):
                key = self.key(words, at)
                self.shift[key] = min(self.shift.get(key, self.jump), length - 1 - at)
            self.bucket.setdefault(self.key(words, length - 1), {})[words] = items

    def key(self, words, at: int) -> int:
        return words[at] if self.block == 1 else words[at - 1] * self.base + words[at]

    def search(self, words: list[int], begin: int, stop: int) -> list[tuple[int, set[int]]]:
        """(first word, items) of each occurrence in words[begin:stop]."""
        found, at, shift, jump, length = [], begin + self.length - 1, self.shift, self.jump, self.length
        base = self.base if self.block == 2 else 0
        while at < stop:
            key = words[at - 1] * base + words[at] if base else words[at]
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            first = at - length + 1
            items = self.bucket[key].get(tuple(words[first:at + 1]))
            if items is not None:
                found.append((first, items))
            at += 1
        return found


class Patterns:
    """The tables of a share of the items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int):
        number: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, words in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            length = min(size, len(ids))
            for at in range(len(ids) - length + 1 if ids else 0):
                by.setdefault(length, {}).setdefault(tuple(ids[at:at + length]), set()).add(item)
        self.vocabulary = pa.array(list(number), pa.large_binary())
        self.lengths = [Lengths(n, p, len(number) + 1) for n, p in sorted(by.items())]


def prepare(items: DataFrame, size: int, item: str = "item_id", text: str = "text", share_bytes: int = SHARE_BYTES) -> tuple[str, int]:
    """Build the tables of all items; their folder and number. Items without an id or a word give no pattern."""
    spark = items.sparkSession
    folder = shared.scratch(spark, "patterns")
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shares = max(1, -(-int(total) // share_bytes))
    source = (items.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")).where("item IS NOT NULL")
              .withColumn("share", F.pmod(F.xxhash64("item", "text"), F.lit(shares)).cast("int")))

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        flat, rows = blocks.words(group.column("text").combine_chunks(), blocks.PLAIN_WORDS, lower=True)
        flat = flat.to_pylist()
        ids = group.column("item").to_pylist()
        made = Patterns([(i, flat[a:b]) for i, a, b in zip(ids, rows, rows[1:])], size)
        name = f"{key[0].as_py():06d}.tables"
        raw = pickle.dumps(made)
        store.put(folder, name, [zlib.crc32(raw).to_bytes(4, "little"), raw])
        return pa.table({"name": [name]})

    names = sorted(r.name for r in source.groupBy("share").applyInArrow(build, "name string").collect())  # one row per share
    return folder, names


def _load(folder: str, name: str) -> Patterns:
    fs, path = store.at(f"{folder}/{name}")
    with fs.open_input_stream(path) as f:
        raw = f.read()
    if zlib.crc32(raw[4:]) != int.from_bytes(raw[:4], "little"):
        raise ValueError(f"{name} is damaged")
    return pickle.loads(raw[4:])  # written by this job's own tasks


load = lru_cache(1)(_load)




def find(df: DataFrame, items: DataFrame, size: int = 10, text: str = "text", share_bytes: int = SHARE_BYTES,
         keep: list[str] | None = None) -> DataFrame:
    """Append ``n_words``, ``hits`` (maximal runs of hit words, first and last) and ``items`` (ids, ascending) to ``df``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts
    have no words and no hits. Rows are judged one by one; repeated item ids count once. Columns of the
    added names are replaced.
    """
    folder, names = prepare(items, size, share_bytes=share_bytes)

    def run(column: pa.Array) -> list[pa.Array]:
        from riskloom.llm import decontaminate as own

        flat, rows = blocks.words(column, blocks.PLAIN_WORDS, lower=True)
        codes, distinct = blocks.coded(flat)
        hit = np.zeros(len(codes), bool)
        n = len(rows) - 1
        found: list[set[int]] = [set() for _ in range(n)]
        for name in names:
            share = own.load(folder, name)
            known = pc.fill_null(pc.index_in(distinct, value_set=share.vocabulary), -1).to_numpy(zero_copy_only=False) + 1
            ids = known[codes].tolist() if len(codes) else []
            for table in share.lengths:
                for row, (a, b) in enumerate(zip(rows.tolist(), rows[1:].tolist())):
                    for first, which in table.search(ids, a, b):
                        hit[first:first + table.length] = True
                        found[row] |= which
        edge = hit.copy()
        edge[1:] = hit[1:] & ~hit[:-1]
        edge[rows[:-1][rows[:-1] < len(hit)]] = hit[rows[:-1][rows[:-1] < len(hit)]]
        first = np.flatnonzero(edge)
        stop = hit.copy()
        stop[:-1] = hit[:-1] & ~hit[1:]
        ends = rows[1:][rows[1:] > 0] - 1
        stop[ends] = hit[ends]
        last = np.flatnonzero(stop)
        of = np.searchsorted(rows, first, side="right") - 1
        begin = rows[:-1][of]
        spans = pa.StructArray.from_arrays([pa.array(first - begin, pa.int32()), pa.array(last - begin, pa.int32())], names=["first", "last"])
        return [pa.array(np.diff(rows), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(first, rows), pa.int32()), spans),
                pa.array([sorted(s) for s in found], pa.list_(pa.int64()))]

    return blocks.map_text(df, text, HITS, run, keep)
