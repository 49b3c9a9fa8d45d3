"""Vector codes against plain Python, and the tree against all distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int, note string"


def brute(rows, parts, entries, rounds):
    """{row number: (code, error)} and the codebooks, by the definition."""
    kept = [(k, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, (i, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    size = len(first[0][2])
    kept = [r for r in kept if len(r[2]) == size]
    width = size // parts
    books = [[r[2][p * width:(p + 1) * width] for r in first if len(r[2]) == size][:entries] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                x = v[p * width:(p + 1) * width]
                groups.setdefault(nearest(books[p], x)[1], []).append(x)
            for i, xs in groups.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    out = {}
    for k, _, v in kept:
        found = [nearest(books[p], v[p * width:(p + 1) * width]) for p in range(parts)]
        out[k] = bytes(i for _, i in found), sum(d for d, _ in found)
    return out, books


@pytest.mark.parametrize("entries", [64, 5, 256])
def test_codes_equal_brute_force(spark, entries):
    rng = random.Random(entries)
    grid = [x / 64 for x in range(-9, 9)]
    rows = [(k if k % 7 else 3, [rng.choice(grid) for _ in range(8)]) for k in range(400)]  # id 3 repeats
    rows += [(None, rows[1][1]), (-1, None), (-2, [0.5, None] * 4), (-3, [float("nan")] * 8), (-4, [float("-inf")] * 8), (-5, []), (9, [1.0] * 7), *rows[:9]]
    frame = spark.createDataFrame([(i, v, k, "kept") for k, (i, v) in enumerate(rows)], SCHEMA).repartition(3)
    made, books = gnat.compress(frame, parts=4, entries=entries)
    want, want_books = brute(rows, 4, entries, 2)
    assert books.tolist() == want_books
    assert {r.label: (bytes(r.code), r.error) for r in made.collect()} == want
    assert all(r.note == "kept" for r in made.collect())


def test_tree_finds_the_nearest_and_skips_subtrees():
    rng = np.random.default_rng(1)
    for width, spread in ((1, 3), (2, 40), (4, 100), (4, 1 << 27)):
        entries = rng.integers(-spread, spread, (64, width))
        rows = np.concatenate([rng.integers(-spread, spread, (3000, width)), entries])
        tree = gnat.Tree(entries)
        index, best = tree.nearest(rows)
        every = ((rows[:, None] - entries) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
        assert width == 1 or tree.visited < every.size * 0.75
    same = gnat.Tree(np.zeros((64, 3), np.int64))
    assert (same.nearest(np.ones((5, 3), np.int64))[0] == 0).all()


def test_edge_tables(spark):
    empty, books = gnat.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and books.shape == (16, 0, 0)
    few, books = gnat.compress(spark.createDataFrame([(1, [1.0] * 16, 0, "x"), (2, [2.0e30] * 16, 0, "x")], SCHEMA))
    assert [(bytes(r.code), r.error) for r in few.collect()] == [(bytes(16), 0)] and books.tolist() == [[[256]]] * 16
    uneven, _ = gnat.compress(spark.createDataFrame([(1, [1.0] * 17, 0, "x")], SCHEMA))
    assert uneven.count() == 0
    names = spark.createDataFrame([(1, [1.0] * 16, "a", "b", 5, 6)], "vec_id long, embedding array<float>, code string, error string, _row int, _x int")
    assert [(r._row, r._x, r.error) for r in gnat.compress(names)[0].collect()] == [(5, 6, 0)]


def test_recall_of_codes(spark):
    """Nearest vectors by decoded parts: the ten nearest of every hundredth vector are mostly among the 50 nearest by code."""
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", F.col("label"))
    made, books = gnat.compress(frame)
    rows = sorted(made.collect())
    x = np.array([r.embedding for r in rows]) * 256
    decoded = np.stack([books[p][[r.code[p] for r in rows]] for p in range(16)], 1).reshape(len(rows), -1)
    hit = []
    for k in range(0, len(rows), 100):
        true = np.argsort(((x - x[k]) ** 2).sum(1), kind="stable")[:10]
        near = np.argsort(((decoded - x[k]) ** 2).sum(1), kind="stable")[:50]
        hit.append(len(set(true) & set(near)) / 10)
    assert np.mean(hit) >= 0.9
