"""Quality rules with an n-gram perplexity.

Symbols are 61 classes of UTF-8 bytes (letters without case, digits, marks, lead and trail bytes) and the
edge of a word, so a word spells a run of symbols and an n-gram has at most 64**ORDER values in each language. This model
of spelling is small; word order and choice are judged by the word n-grams of ``wordmodel``, whose counts grow with the corpus. Spark counts the n-grams of all words of all
documents, takes continuation counts and discounts of modified Kneser-Ney smoothing, and writes each
language's tables sorted by hash. Tasks look n-grams up in these arrays by binary search, once for each
distinct word of a slice.

The log perplexity of a text is the median of its lines', each weighed by its symbols, so that a foreign
passage or a table inside a text does not decide. A document passes if it lies between its language's quartiles, widened on both
sides by ``WIDTH`` times their distance, or ``LEAST`` if that is more. The word perplexity is the mean over all words of the
text and must lie in a band of its own (``WORD_WIDTH``, ``LEAST``).
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks, stats, store, wordmodel
from riskloom.operators.ordering import exact_quantiles
from riskloom.sources import shared

ORDER = 4
WIDTH, LEAST = 4.0, 0.1
WORD_WIDTH = 3.0  # Tukey's outer fences
BITS = 6
EDGE = 0


def _classes() -> np.ndarray:
    """Class 1..63 of each byte."""
    out = np.full(256, 38, np.uint8)  # other ASCII
    for k in range(26):
        out[65 + k] = out[97 + k] = 1 + k
    out[48:58] = 27
    for k, c in enumerate(b".,;:!?'\"()"):
        out[c] = 28 + k
    out[0x80:0xC0] = 39 + (np.arange(64) & 15)
    out[0xC0:0xE0] = 55 + np.minimum(np.abs(np.arange(32) - 2), 4)
    out[0xE0:0xF0] = 60
    out[0xF0:] = 61
    return out


CLASSES = _classes()


def grams(distinct: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of each word with its end, in order, and the offsets of the words. The first are padded with the edge."""
    _, cuts, data = distinct.buffers()
    cuts = np.frombuffer(cuts, np.int64)[:len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
    data = CLASSES[np.frombuffer(data or b"", np.uint8)[:cuts[-1]]]
    n = len(cuts) - 1
    size = np.diff(cuts) + order  # order - 1 edges before, one after
    at = np.concatenate([[0], np.cumsum(size)])
    line = np.full(at[-1], EDGE, np.int64)
    line[np.arange(len(data)) + np.repeat(np.arange(n) * order + order - 1, np.diff(cuts))] = data
    key = np.zeros(max(0, len(line) - order + 1), np.int64)
    for k in range(order):
        key = key << BITS | line[k:len(line) - order + 1 + k]
    starts = np.ones(len(line), bool)  # positions whose n-gram stays in its word
    for k in range(1, order):
        starts[at[1:] - k] = False
    return key[starts[:len(key)]], np.concatenate([[0], np.cumsum(size - order + 1)])


def hashed(key: np.ndarray, order: int) -> np.ndarray:
    return blocks.mix(key.astype(np.uint64) ^ np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)


def count(df: DataFrame, lang: str, text: str, order: int) -> DataFrame:
    """(lang, gram, n) over all words; each task sends an n-gram once."""
    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in blocks.slices(batches, text):
            for code in part.column(lang).unique().to_pylist():
                column = part.column(text).filter(pc.equal(part.column(lang), code))
                flat, _ = blocks.words(column, blocks.BLANK_WORDS)
                codes, distinct = blocks.coded(flat)
                key, at = grams(distinct, order)
                times = np.repeat(np.bincount(codes, minlength=len(distinct)), np.diff(at))
                gram, kinds = blocks.coded(pa.array(key))
                key, times = kinds.to_numpy(), np.bincount(gram, times, len(kinds)).astype(np.int64)
                if code in held:
                    key, times = np.concatenate([held[code][0], key]), np.concatenate([held[code][1], times])
                key, of = np.unique(key, return_inverse=True)
                held[code] = key, np.bincount(of, times, len(key)).astype(np.int64)
        for code, (key, times) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(times, pa.int64())], names=["lang", "gram", "n"])

    return df.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, lang: str, text: str, order: int = ORDER) -> str:
    """Count, smooth and store the model; its folder. Below, gram keeps an order's symbols and context drops the last."""
    spark = df.sparkSession
    folder = shared.scratch(spark, "ngrams")
    level = shared.materialize(count(df, lang, text, order))
    for k in range(order, 0, -1):
        # Discounts of this order from its counts of counts.
        of = [F.sum((F.col("n") == j).cast("long")).alias(f"t{j}") for j in (1, 2, 3, 4)]
        y = F.when(F.col("t1") + 2 * F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)
        cut = [F.least(F.lit(j - 0.01), F.greatest(F.lit(0.1), F.when(F.col(f"t{j}") > 0, j - (j + 1) * y * F.col(f"t{j + 1}") / F.col(f"t{j}")).otherwise(0.5 * j))).alias(f"d{j}") for j in (1, 2, 3)]
        discounts = blocks.light(level.groupBy("lang").agg(*of).select("lang", *cut))
        cut_here = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        each = level.join(discounts, "lang").select("lang", "gram", "n", cut_here.alias("d"), F.shiftright("gram", BITS).alias("context"))
        grams_k = each.select("lang", F.lit(k).alias("order"), F.lit(0).alias("kind"), F.col("gram").alias("key"), (F.col("n") - F.col("d")).alias("a"), F.lit(0.0).alias("b"))
        contexts = each.groupBy("lang", "context").agg(F.sum("n").alias("a"), F.sum("d").alias("b"))
        contexts_k = contexts.select("lang", F.lit(k).alias("order"), F.lit(1).alias("kind"), F.col("context").alias("key"), F.col("a").cast("double").alias("a"), "b")
        grams_k.unionByName(contexts_k).write.mode("append").parquet(f"{folder}/levels")
        if k > 1:  # how many different symbols come before each shorter n-gram
            level = level.groupBy("lang", (F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
            level = shared.materialize(level)

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name = f"{key[0].as_py().encode().hex() or 'none'}.{key[1].as_py()}.{key[2].as_py()}.arrays"
        h = hashed(table.column("key").to_numpy(), key[1].as_py() * 2 + key[2].as_py())
        by = np.argsort(h)
        sink = pa.BufferOutputStream()
        pq.write_table(pa.table({"h": h[by], "a": table.column("a").to_numpy()[by].astype(np.float32), "b": table.column("b").to_numpy()[by].astype(np.float32)}), sink)
        store.put(f"{folder}/sorted", name, [sink.getvalue()])
        return pa.table({"name": [name]})

    spark.read.parquet(f"{folder}/levels").groupBy("lang", "order", "kind").applyInArrow(sort, "name string").count()
    return f"{folder}/sorted"


class Model:
    """A language's sorted arrays of hashes, counts and weights."""

    def __init__(self, folder: str, lang: str, order: int):
        fs, path = store.at(folder)
        self.order, self.tables = order, {}
        for k in range(1, order + 1):
            for kind in (0, 1):
                with fs.open_input_file(f"{path}/{lang.encode().hex() or 'none'}.{k}.{kind}.arrays") as f:
                    t = pq.read_table(f)
                self.tables[k, kind] = tuple(t.column(c).to_numpy() for c in "hab")

    def look(self, key: np.ndarray, k: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        h, a, b = self.tables[k, kind]
        want = hashed(key, k * 2 + kind)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        found = h[at] == want
        return np.where(found, a[at], 0), np.where(found, b[at], 0)

    def log(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each n-gram."""
        p = np.full(len(key), 2.0 ** -BITS)
        for k in range(1, self.order + 1):
            part = key & (1 << BITS * k) - 1
            own, _ = self.look(part, k, 0)
            total, back = self.look(part >> BITS, k, 1)
            seen = total > 0
            p = np.where(seen, (own + back * p) / np.where(seen, total, 1), p)
        return np.log(p)


_models: OrderedDict = OrderedDict()


def model(folder: str, lang: str, order: int) -> Model:
    """At most eight languages stay in a worker's memory."""
    if (folder, lang) not in _models:
        _models[folder, lang] = Model(folder, lang, order)
        if len(_models) > 8:
            _models.popitem(last=False)
    _models.move_to_end((folder, lang))
    return _models[folder, lang]


def median(log: np.ndarray, symbols: np.ndarray, lines: np.ndarray, line_rows: np.ndarray, n: int) -> np.ndarray:
    """Of each row the median of its lines' mean negative logs, weighed by symbols; NaN without symbols."""
    total, weight = (np.diff(np.concatenate([[0], np.cumsum(v)])[lines]) for v in (log, symbols))
    some = weight > 0
    value, weight, row = -total[some] / weight[some], weight[some], line_rows[some]
    by = np.lexsort((value, row))
    value, weight, row = value[by], weight[by], row[by]
    upto = np.cumsum(weight)
    whole = np.bincount(row, weight, n)
    before = np.cumsum(whole) - whole
    half = np.flatnonzero(2 * (upto - before[row]) >= whole[row])
    out = np.full(n, np.nan)
    out[row[half[::-1]]] = value[half[::-1]]  # the first of each row is written last
    return out


def fences(passed: DataFrame, of: dict[str, tuple[str, float]], least: float) -> DataFrame:
    """For each language and column: exact quartiles, widened by a multiple of their distance, as ``<prefix>low`` and ``<prefix>high``."""
    values = F.inline(F.array(*(F.struct(F.lit(c).alias("_of"), F.col(c).alias("_value")) for c in of)))
    found = exact_quantiles(passed.select("_lang", values), "_value", [0.25, 0.75], ["_lang", "_of"])
    at = lambda c, q: F.max(F.when((F.col("_of") == c) & (F.col("q") == q), F.col("value")))
    out = []
    for c, (prefix, width) in of.items():
        spread = F.greatest(width * (at(c, 0.75) - at(c, 0.25)), F.lit(least))
        out += [(at(c, 0.25) - spread).alias(f"{prefix}low"), (at(c, 0.75) + spread).alias(f"{prefix}high")]
    return found.groupBy("_lang").agg(*out)


def score(df: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, width: float = WIDTH, least: float = LEAST,
          word_width: float = WORD_WIDTH) -> DataFrame:
    """Append counts, ``log_perplexity``, ``word_log_perplexity``, ``base_failed``, the bands and ``kept`` to ``df``.

    A null language is one of its own. Texts without words have no perplexity (null) and fail the base rules,
    as all texts under 50 words do. Bands are set by the documents that pass the base rules. Columns of the
    added names are replaced, others stay; repeated rows are scored alike.
    """
    spark: SparkSession = df.sparkSession
    source = df.withColumn("_lang", F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")))
    with shared.scope(spark):
        folder = train(source.select(F.col("_lang").alias("lang"), F.col(f"`{text}`").alias("text")), "lang", "text", order)
    names = stats.NAMES[:5]
    added = T.StructType([*(T.StructField(c, T.LongType()) for c in names), T.StructField("log_perplexity", T.DoubleType()),
                          T.StructField("word_log_perplexity", T.DoubleType())])
    kept = [c for c in df.columns if c not in added.names and c not in ("base_failed", "low", "high", "word_low", "word_high", "kept")] + ["_lang"]
    asked = source.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{text}`"]))
    counted = wordmodel.count(asked, "_lang", text)
    schema = T.StructType([*(source.schema[c] for c in kept), *added])

    def run(batches):
        from riskloom.llm import perplexity as own

        for part in blocks.slices(batches, text):
            made, words = stats.counts(part.column(text), names)
            key, cut = grams(words.distinct, order)
            line = np.array(part.column("_lang").to_pylist(), object)
            of = np.repeat(np.arange(len(line)), np.diff(words.rows))
            log = np.zeros(len(words.codes))
            for code in set(line):
                mine = (line == code)[of]
                used = np.zeros(len(words.distinct), bool)
                used[words.codes[mine]] = True
                at = np.flatnonzero(np.repeat(used, np.diff(cut)))
                logs = np.zeros(len(key))
                if len(at):
                    gram, kinds = blocks.coded(pa.array(key[at]))
                    logs[at] = own.model(folder, code, order).log(kinds.to_numpy())[gram]
                upto = np.concatenate([[0], np.cumsum(logs)])
                log[mine] = (upto[cut[1:]] - upto[cut[:-1]])[words.codes[mine]]
            each = own.wordmodel.score(counted, part, text, line, words, log)
            value = own.median(log, np.diff(cut)[words.codes], words.lines, words.line_rows, len(line))
            value = pa.array(np.round(value, 9), mask=np.isnan(value))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(made[c], pa.int64()) for c in names), value, pa.array(np.round(each, 9), mask=np.isnan(each))], names=schema.names)

    scored = shared.materialize(asked.mapInArrow(run, schema))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    bands = blocks.light(fences(scored.where(~F.col("base_failed")), {"log_perplexity": ("", width), "word_log_perplexity": ("word_", word_width)}, least))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high")) & F.col("word_log_perplexity").between(F.col("word_low"), F.col("word_high"))
    return scored.join(bands, "_lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_lang")
