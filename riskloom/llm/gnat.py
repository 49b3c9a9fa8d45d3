"""Vector codes: each vector becomes one codebook index for each of its parts, all in integers.

The nearest entry of a codebook is found by a geometric near-neighbour access tree (GNAT) over its entries. A node
has split points and, for each child and each split point, the least and greatest distance of the child's entries
to that point. A query whose distance to any split point lies further from that range than the best distance so far
skips the child whole. Distances of the tree are rounded so that only strictly worse subtrees go; whatever is
visited is compared by integer squared distance, then by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks
from riskloom.sources import shared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SPLITS, LEAF = 8, 12
#: Components of more than this (as integers) could leave 64 bits in sums of squares.
LARGEST = 1 << 27
#: Up to here products of components add up exactly in float64, for parts of up to 1,024 components.
EXACT = 1 << 20
#: Rows handled at once in a task.
ROWS = 1 << 14


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows of ``a`` to those of ``b``, exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if max(-a.min(), a.max(), -b.min(), b.max()) <= EXACT and a.shape[1] <= 1024:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def below(d2: np.ndarray) -> np.ndarray:
    """A float not above the root of integers; ``above`` gives one not below it."""
    return np.sqrt(d2.astype(np.float64)) * (1 - 1e-12)


def above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + 1e-12)


@dataclass
class Node:
    """Split points by index of entry; for child c and split point s the range [low[c, s], high[c, s]]."""
    points: np.ndarray
    children: list["Node | None"] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def build(entries: np.ndarray, ids: np.ndarray | None = None) -> Node:
    """The tree over a codebook. Up to ``LEAF`` entries are a node without children.

    Split points are chosen each as far as possible from those before; every other entry goes to the child of its nearest
    split point. When all entries left are equal the tree still ends, since split points leave the set.
    """
    ids = np.arange(len(entries)) if ids is None else ids
    if len(ids) <= LEAF:
        return Node(ids)
    points, far = [0], squared(entries[ids], entries[ids[:1]])[:, 0]
    for _ in range(SPLITS - 1):
        far[points] = -1
        points.append(int(far.argmax()))
        far = np.minimum(far, squared(entries[ids], entries[ids[points[-1:]]])[:, 0])
    chosen, rest = ids[points], np.delete(ids, points)
    d2 = squared(entries[rest], entries[chosen])
    home = d2.argmin(1)
    low, high = np.full((SPLITS, SPLITS), np.inf), np.full((SPLITS, SPLITS), -np.inf)
    children: list[Node | None] = []
    for c in range(SPLITS):
        of = home == c
        children.append(build(entries, rest[of]) if of.any() else None)
        if of.any():
            low[c], high[c] = below(d2[of].min(0)), above(d2[of].max(0))
    return Node(chosen, children, low, high)


class Tree:
    """Nearest entries of one codebook. ``visited`` counts the distances that queries have taken."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root, self.visited = entries, build(entries), 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (of equally near ones the least index) and its squared distance."""
        index = np.full(len(rows), len(self.entries), np.int64)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        self._visit(self.root, rows, np.arange(len(rows)), index, best)
        return index, best

    def _visit(self, node: Node, rows: np.ndarray, some: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        d2 = squared(rows[some], self.entries[node.points])
        self.visited += d2.size
        for k, point in enumerate(node.points):
            won = (d2[:, k] < best[some]) | ((d2[:, k] == best[some]) & (point < index[some]))
            index[some[won]], best[some[won]] = point, d2[won, k]
        if not node.children:
            return
        near, far, home = below(d2), above(d2), d2.argmin(1)
        # The child of the nearest split point first: it shrinks the ball that the others must meet.
        for own in (True, False):
            for c, child in enumerate(node.children):
                if child is None:
                    continue
                reach = above(best[some])
                meets = ((far + reach[:, None] >= node.low[c]) & (near - reach[:, None] <= node.high[c])).all(1) & ((home == c) == own)
                if meets.any():
                    self._visit(child, rows, some[meets], index, best)


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, pa.Array]:
    """(which rows are whole, their components as floor(scale * x)) of a column of vectors of doubles."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    x = np.floor(np.asarray(flat.to_numpy(zero_copy_only=False), np.float64) * scale)
    of = np.repeat(np.arange(len(column)), lengths)
    bad = np.bincount(of[~(np.abs(x) <= LARGEST)], minlength=len(column)) > 0  # null is NaN here
    good = ~bad & ~column.is_null().to_numpy(zero_copy_only=False) & (lengths > 0)
    return good, blocks.lists(x[good[of]].astype(np.int64), np.concatenate([[0], np.cumsum(lengths[good])]), pa.int64())


def whole(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(_row, _x): the rows of ``df`` as a struct with the vector as integers, without rows whose vector is null, empty, or holds
    a null, non-finite or too large (``LARGEST``) component."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(f"`{vector}`").cast("array<double>").alias("_x"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_x", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good, x = integers(batch.column("_x"), scale)
                yield pa.RecordBatch.from_arrays([batch.column("_row").filter(pa.array(good)), x], names=["_row", "_x"])

    return rows.mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def first_entries(rows: DataFrame, key: str, entries: int) -> tuple[np.ndarray, int]:
    """The vectors of the least keys, in order (null keys last, of repeated keys by vector), and how many components they have.

    The length is that of the least key's vector.
    """
    order = [F.col(f"_row.`{key}`").asc_nulls_last(), F.col("_x").asc()]
    top = rows.orderBy(*order).select(F.size("_x").alias("n")).first()
    if top is None:
        return np.zeros((0, 0), np.int64), 0
    chosen = rows.where(F.size("_x") == top.n).orderBy(*order).limit(entries).select("_x").collect()
    return np.array([r._x for r in chosen], np.int64), top.n


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign each part to its nearest entry, then the floor of the mean of an entry's parts.

    A task sends at most one row of sums for each entry; the books (parts x entries x components) are all that
    the driver receives.
    """
    parts, entries, width = books.shape
    schema = "part int, entry int, n long, total array<decimal(38,0)>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column("_x").slice(at, ROWS)).reshape(-1, parts, width)
                for p in range(parts):
                    index, _ = trees[p].nearest(x[:, p])
                    some = np.zeros((entries, width), np.int64)
                    np.add.at(some, index, x[:, p])
                    n[p] += np.bincount(index, minlength=entries)
                    total[p] += some
        part, entry = np.nonzero(n)
        sums = pa.array([[int(v) for v in total[p, e]] for p, e in zip(part, entry)], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), sums], names=["part", "entry", "n", "total"])

    sent = rows.select("_x").mapInArrow(run, schema).select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
    means = sent.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = books.copy()
    for r in means:
        out[r.part, r.entry, r.at] = int(r.total) // r.n
    return out


def fit(rows: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) of rows (_row, _x); none if there are no rows or the length cannot be cut."""
    start, size = first_entries(rows, key, entries)
    if not size or size % parts:
        return np.zeros((parts, 0, 0), np.int64)
    books = start.reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy()
    rows = rows.where(F.size("_x") == size)
    for _ in range(rounds):
        books = improve(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray, code: str, error: str) -> DataFrame:
    """(_row, code, error) of the rows (_row, _x) that have the length of the books."""
    parts, entries, width = books.shape
    schema = T.StructType([rows.schema["_row"], T.StructField(code, T.BinaryType()), T.StructField(error, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = matrix(piece.column("_x")).reshape(-1, parts, width)
                found = [trees[p].nearest(x[:, p]) for p in range(parts)]
                index = np.stack([i for i, _ in found], 1).astype(np.uint8)
                codes = blocks.strings(index.ravel(), np.arange(len(x) + 1) * parts, pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("_row"), codes, pa.array(sum(d for _, d in found), pa.int64())], names=["_row", code, error])

    return rows.where(F.size("_x") == parts * width if entries else F.lit(False)).mapInArrow(run, schema)


def text(books: np.ndarray) -> str:
    """All components of all entries by part, entry and position, in decimals."""
    return ",".join(map(str, books.ravel().tolist()))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(text(books).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", code: str = "code", error: str = "error", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows with ``code`` (a byte for each part) and ``error`` (squared distance), and the codebooks.

    Codebooks start from the vectors of the least keys. Left out are rows whose vector is null, empty, holds a null, non-finite
    or too large component, or is not as long as that of the least key; if that length has no ``parts`` equal parts, all rows.
    Fewer rows than ``entries`` give smaller codebooks. Repeated rows count each; null keys come last. Columns
    of the added names are replaced, all others are kept.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    kept = [c for c in df.columns if c not in (code, error) or c == vector]
    rows = shared.materialize(whole(df.select(*(F.col(f"`{c}`") for c in kept)), vector, scale))
    books = fit(rows, key, parts, entries, rounds)
    made = encode(rows, books, "_code", "_error")
    keep = [c for c in kept if c not in (code, error)]
    return made.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), F.col("_code").alias(code), F.col("_error").alias(error)), books
