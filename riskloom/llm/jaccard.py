"""Documents linked by the Jaccard similarity of their word shingles, and the groups that links form.

Equal sets are merged first, so copies cost one row each. Blocks bring together sets that agree on
``ROWS`` minimum hashes; there are as many blocks for each set as make the chance to miss a link of the least
similarity smaller than ``MISS`` (less for closer ones). Links to the first set of each block are checked at once,
which joins most of what belongs together. Blocks that still hold several groups are searched by
signature trees: nodes hold OR-combined token bitmaps and size ranges, and a traversal of node pairs leaves out
those whose greatest possible overlap is too small or that lie in one group already. What is left
is checked on the whole sets. Groups are found by contraction; no group, block or set is gathered in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks
from riskloom.sources import shared

SHINGLE, PERCENT = 5, 75
ROWS, MISS = 3, 1e-10
BITS = 2048
LEAF, FAN = 8, 8
CELL = 1500  # sets that one task searches at most against each other
PAIRS = 1 << 12  # node pairs opened at once
GOLD = np.uint64(0x9E3779B97F4A7C15)


def bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-word shingles, ascending and distinct in each row, and the rows' offsets.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; fewer than k words make one shingle, none make none.
    """
    flat, rows = blocks.words(column, blocks.BLANK_WORDS, lower=True)
    codes, distinct = blocks.coded(flat)
    word = blocks.hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(rows)
    key = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        key = blocks.mix((key + GOLD) ^ word[j:len(word) - k + 1 + j]) if len(key) else key
    whole = np.ones(len(key), bool)
    row = np.repeat(np.arange(len(n)), n)
    if len(key):
        whole = row[:len(key)] == row[k - 1:]
    short = np.flatnonzero((n > 0) & (n < k))
    few = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short.tolist()):
        h = np.array([n[r]], np.uint64)
        for w in word[rows[r]:rows[r + 1]]:
            h = blocks.mix((h + GOLD) ^ w)
        few[i] = h[0]
    key, row = np.concatenate([key[whole], few]), np.concatenate([row[:len(whole)][whole], short])
    by = np.lexsort((key, row))
    key, row = key[by], row[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]).astype(np.int64)


def describe(df: DataFrame, text: str, k: int, n_bands: int, keep: list[str]) -> DataFrame:
    """Per row: n_shingles, _key (128-bit name of the set), _bands, _bits."""
    multipliers = blocks.mix(np.arange(1, n_bands * ROWS + 1, dtype=np.uint64) * GOLD) | np.uint64(1)

    def run(column: pa.Array) -> list[pa.Array]:
        key, at = sets(column, k)
        size = np.diff(at)
        full = np.flatnonzero(size)
        start = at[:-1][full]
        out = np.zeros((len(full), n_bands), np.uint64)
        name = np.zeros((len(size), 2), np.uint64)
        bits = np.zeros((len(size), BITS), bool)
        if len(full):
            for b in range(n_bands):
                h = np.full(len(full), b, np.uint64)
                for r in range(ROWS):
                    h = blocks.mix((h + GOLD) ^ np.minimum.reduceat(key * multipliers[b * ROWS + r], start))
                out[:, b] = h
            name[full, 0] = np.add.reduceat(blocks.mix(key ^ GOLD), start)
            name[full, 1] = np.add.reduceat(blocks.mix(key + GOLD), start)
            bits[np.repeat(np.arange(len(size)), size), (key >> np.uint64(53)).astype(np.int64)] = True
        offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, n_bands, 0))])
        return [pa.array(size, pa.int64()), pa.array([r.tobytes() for r in name], pa.binary()),
                blocks.lists(out.reshape(-1).astype(np.int64), offsets, pa.int64()),
                pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())]

    added = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("_key", T.BinaryType()),
                          T.StructField("_bands", T.ArrayType(T.LongType(), False)), T.StructField("_bits", T.BinaryType())])
    return blocks.map_text(df, text, added, run, keep)


class Tree:
    """Sets of one cell in order of size; nodes of level 0 are sets, each higher node covers FAN (first LEAF) below it."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, group: np.ndarray):
        excess = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, excess, group)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess, group = self.levels[-1]
            at = np.arange(0, len(low), step)
            one = np.minimum.reduceat(group, at) == np.maximum.reduceat(group, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(excess, at), np.where(one, group[at], -1 - np.arange(len(at)))))
            step = FAN

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold a link between groups: size ranges and the greatest overlap the bitmaps allow."""
        bits, low, high, excess, group = self.levels[level]
        ok = (group[i] != group[j]) & (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        at = np.flatnonzero(ok)
        for a in range(0, len(at), PAIRS):
            part = at[a:a + PAIRS]
            x, y = i[part], j[part]
            overlap = np.minimum(np.bitwise_count(bits[x] & bits[y]).sum(1) + np.minimum(excess[x], excess[y]), np.minimum(high[x], high[y]))
            ok[part] = (100 + percent) * overlap >= percent * (low[x] + low[y])
        return ok

    def pairs(self, percent: int):
        """Pairs of sets that may be linked and lie in different groups, in pieces."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > PAIRS:
                todo += [(level, i[a:a + PAIRS], j[a:a + PAIRS]) for a in range(0, len(i), PAIRS)]
                continue
            # A node with itself: its own sets may differ in group unless it is of one.
            own = (i == j) & (self.levels[level][4][i] < 0 if level else False)
            ok = self.possible(level, i, j, percent) | own
            i, j = i[ok], j[ok]
            if not level:
                if len(i):
                    yield i, j
                continue
            fan, n = LEAF if level == 1 else FAN, len(self.levels[level - 1][1])
            left, right = np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij")
            i, j = (i[:, None] * fan + left.reshape(-1)).reshape(-1), (j[:, None] * fan + right.reshape(-1)).reshape(-1)
            ok = (i < n) & (j < n) & ((i < j) if level == 1 else (i <= j))
            if ok.any():
                todo.append((level - 1, i[ok], j[ok]))


def search(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates of all cells; of a cell of two salts only pairs across them, of a size class its own and the next."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rep, size, group, salt, class_ = (table.column(c).to_numpy() for c in ("rep", "n", "group", "salt", "class"))
        by = np.lexsort((rep, size))
        raw = b"".join(table.column("bits").to_pylist())
        bits = np.frombuffer(raw, np.uint64).reshape(len(rep), -1)[by]
        rep, size, group, salt, class_ = rep[by], size[by], group[by], salt[by], class_[by]
        _, dense = np.unique(group, return_inverse=True)
        left, right, tile = key[2].as_py(), key[3].as_py(), key[1].as_py()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in Tree(bits, size, dense).pairs(percent):
            ok = np.minimum(class_[i], class_[j]) == tile
            if left != right:
                ok &= salt[i] != salt[j]
            a.append(np.minimum(rep[i[ok]], rep[j[ok]]))
            b.append(np.maximum(rep[i[ok]], rep[j[ok]]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return cells.groupBy("band", "tile", "left", "right").applyInArrow(run, "a long, b long").distinct()


def check(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    left, right = (whole.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where((100 + percent) * common >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b); the label is the least node that can be reached."""
    spark = edges.sparkSession
    ends = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
    with shared.scope(spark) as stay:
        edges = shared.materialize(edges.select("a", "b").distinct())
        labels = shared.materialize(ends(edges).select("node").distinct().withColumn("label", F.col("node")))
        while not edges.isEmpty():
            up = shared.materialize(ends(edges).groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up")))
            top = shared.materialize(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"))
            labels = shared.materialize(labels.join(top.withColumnsRenamed({"node": "label"}), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
            a, b = (top.withColumnsRenamed({"node": c, "top": f"top_{c}"}) for c in "ab")
            moved = edges.join(a, "a").join(b, "b")
            edges = shared.materialize(moved.where("top_a <> top_b").select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct())
        stay.append(labels)
    return labels


def group(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``.

    ``component_id`` is the least key that links reach. Rows without words, or with a null text, have no shingles and
    their own key. Rows that share a key are one node that has each of their texts. A null key takes no part in
    links and has a null component. Other columns are not looked at.
    """
    with shared.scope(df.sparkSession) as stay:
        described = shared.materialize(describe(df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")), "_text", k, bands(percent), ["_id"]))
        known = described.where("n_shingles > 0 AND _id IS NOT NULL")
        named = shared.materialize(known.groupBy("_key").agg(F.min("_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("_bands").alias("bands"), F.first("_bits").alias("bits")))
        # Keys that share a row's text or that a row shares: equal sets, and equal keys.
        twice = known.select("_id", "_key").groupBy("_id").agg(F.min("_key").alias("x"), F.max("_key").alias("y")).where("x <> y").select("_id")
        same = known.select("_id", "_key").join(twice, "_id", "left_semi").distinct().join(named.select("_key", "rep"), "_key")
        same = same.where("rep <> _id").select(F.least("rep", "_id").alias("a"), F.greatest("rep", "_id").alias("b"))

        rows = named.select("rep", F.explode("bands").alias("band"))
        first = rows.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("_last")).where("hub < _last").drop("_last")
        shared_rows = shared.materialize(rows.join(first, "band"))
        pairs = shared.materialize(shared_rows.where("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
        wanted = blocks.light(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())

        def shingles(column: pa.Array) -> list[pa.Array]:
            values, at = sets(column, k)
            return [blocks.lists(values.astype(np.int64), at, pa.int64())]

        texts = df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")).join(wanted, "_id", "left_semi")
        whole = shared.materialize(blocks.map_text(texts.withColumnRenamed("_id", "rep"), "_text", T.StructType([T.StructField("set", T.ArrayType(T.LongType(), False))]), shingles, ["rep"])).where("size(set) > 0")
        links = shared.materialize(check(pairs, whole, percent).union(same))
        labels = components(links)

        # Blocks that still hold more than one group.
        placed = shared_rows.select("band", "rep").join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("group"))
        placed = shared.materialize(placed)
        mixed = placed.groupBy("band").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("band")
        base = math.log(100 / percent)
        entries = placed.join(mixed, "band").join(named.select("rep", "n", "bits"), "rep").withColumn("class", F.floor(F.log("n") / base).cast("int"))
        entries = entries.withColumn("tile", F.explode(F.array(F.col("class"), F.col("class") - 1)))
        cells = shared.materialize(entries)
        many = cells.groupBy("band", "tile").agg(F.count("*").alias("c"), F.min("class").alias("x"), F.max("class").alias("y")).where("c > 1 AND x = tile")
        cells = cells.join(many.select("band", "tile", F.ceil(F.col("c") / CELL).cast("int").alias("salts")), ["band", "tile"])
        cells = cells.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        cells = cells.select("band", "tile", F.least("salt", "other").alias("left"), F.greatest("salt", "other").alias("right"), "salt", "class", "rep", "n", "group", "bits")
        more = search(cells, percent).join(pairs, ["a", "b"], "left_anti")
        links = shared.materialize(links.union(check(more, whole, percent)))
        labels = components(links)
        stay += [described, named, labels]

    reps = named.select("_key", "rep").join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").select("_key", F.coalesce("label", "rep").alias("_label"))
    full = F.when((F.col("n_shingles") > 0) & F.col("_id").isNotNull(), F.col("_key"))
    out = described.select("_id", "n_shingles", full.alias("_key")).join(reps, "_key", "left")
    return out.select(F.col("_id").alias(key), "n_shingles", F.coalesce("_label", "_id").alias("component_id"))


