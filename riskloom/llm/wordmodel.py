"""Counts of word n-grams over the whole corpus, and what a trigram model of them says of each text.

Words without case, orders 0 to 3, across words and lines; n-grams are 48-bit hashes mixed with their language. A task sends
each n-gram of a slice once, packed, to its home, a range of hashes; the number of homes grows with the text. Homes add up
and answer every slice with the counts of its n-grams. So neither the counts nor what a task holds is bounded by a fixed model.

Texts fall in two halves by their hash, copies in the same one, and a text is judged by the counts of the other
half: no text vouches for itself. Smoothing is hierarchical (Dirichlet), from the spelling of a word up:
p_k = (count + ``PRIOR`` p_(k-1)) / (count of the context + ``PRIOR``).

Words are counted first, then pairs, then triples (``ROUNDS``). An n-gram of which one half lacks the first or the last n - 1 words
is not in that half: its count there is 0 and nobody there asks for it, so it is not sent. That leaves out no count that is used.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks, stats, store
from riskloom.sources import shared

ORDERS = 4
ROUNDS = ((0, 1), (2,), (3,))  # the orders that are counted together
PRIOR = 4.0
KEY_BITS = 48
HOME_BYTES = 8 << 20  # text for each home
EDGE = np.uint64(0x5851F42D4C957F2D)


def folded(words) -> np.ndarray:
    """Hash of each distinct word, without case."""
    _, cuts, data = words.distinct.buffers()
    if not len(words.distinct):
        return np.zeros(0, np.uint64)
    cuts = np.frombuffer(cuts, np.int64)[:len(words.distinct) + 1]
    return blocks.hash_words(blocks.strings(blocks.LOWER[np.frombuffer(data or b"", np.uint8)[:cuts[-1]]], cuts))


def sequence(words, lang: np.ndarray, orders: int = ORDERS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of orders 0 to ``orders`` - 1 of an edge and the words of each row; row and place in ``codes`` of each (-1: edge), and where each row's begin."""
    n = np.diff(words.rows)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    row = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(at[-1]) - row - 1
    place[at[:-1]] = -1
    w = np.full(at[-1], EDGE)
    w[place >= 0] = folded(words)[words.codes]
    before = []
    for k in range(1, orders - 1):
        prior = np.full(len(w), EDGE)
        prior[k:] = w[:-k] if len(w) > k else prior[k:]
        near = np.arange(len(w)) - at[:-1][row] < k
        prior[near] = EDGE
        before.append(prior)
    names, code = np.unique(lang.astype(str), return_inverse=True)
    seed = blocks.hash_words(pa.array([x.encode() for x in names], pa.large_binary()))[code][row] if len(names) else np.zeros(0, np.uint64)
    keys = [blocks.mix(seed)]
    for k, x in enumerate((w, *before)):  # the last word first
        keys.append(blocks.mix(keys[-1] * np.uint64(3) ^ x + np.uint64(k)))
    return [k >> np.uint64(64 - KEY_BITS) for k in keys], row, place, at


def contexts(n: int, at: np.ndarray) -> np.ndarray:
    """Position of each n-gram's context, the one that ends a word earlier, one order less; an edge stands before itself."""
    back = np.arange(n) - 1
    back[at[:-1]] += 1
    return back


def numbered(keys: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the number of each key among them. Words repeat much, so only distinct ones are sorted."""
    if r:
        return np.unique(keys, return_inverse=True)
    codes, distinct = blocks.coded(pa.array(keys))
    distinct = distinct.to_numpy()
    by = np.argsort(distinct)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return distinct[by], rank[codes]


class Half(NamedTuple):
    """The rows of a slice that lie in one half: positions, the context of each (as a place in ``mine``), by order the times of each one's
    n-gram in the other half, and distinct keys and times of the n-grams that the next round asks for."""

    f: int
    mine: np.ndarray
    back: np.ndarray
    known: list[np.ndarray]
    distinct: np.ndarray
    times: np.ndarray


def halves(part, text: str, words, lang: np.ndarray, folder: str, done: int) -> tuple[np.ndarray, np.ndarray, list[Half]]:
    """Row and place of each position, and the halves of a slice after so many rounds."""
    asks = ROUNDS[done] if done < len(ROUNDS) else ()
    keys, row, place, at = sequence(words, lang, max(asks, default=ORDERS - 1) + 1)
    data, rows = blocks.buffers(part.column(text))
    half = (blocks.hash_words_long(data, rows) & np.uint64(1)).astype(np.int64)[row]
    files = Answers(folder, name(part, text, lang))
    nth, made = np.zeros(len(row), np.int64), []
    for f in (0, 1):
        mine = np.flatnonzero(half == f)
        if not len(mine):
            continue
        nth[mine] = np.arange(len(mine))
        back = nth[contexts(len(row), at)[mine]]
        known, live = [], np.arange(len(mine))
        for r in range(done):
            distinct, of = numbered(np.concatenate([keys[k][mine[live]] for k in ROUNDS[r]]), r)
            times = files.read(r, f, len(distinct))
            for one in of.reshape(len(ROUNDS[r]), len(live)):
                known.append(np.zeros(len(mine)))
                known[-1][live] = times[one]
            live = np.flatnonzero((known[-1] > 0) & (known[-1][back] > 0))
        distinct, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys[k][mine[live]] for k in asks)]), return_counts=True)
        made.append(Half(f, mine, back, known, distinct, times))
    return row, place, made


class Answers:
    """The counts that a slice asked for, round by round."""

    def __init__(self, folder: str, slice_: int):
        self.folder, self.slice, self.tables = folder, slice_, {}

    def read(self, r: int, f: int, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0)
        if r not in self.tables:
            fs, path = store.at(self.folder)
            with fs.open_input_file(f"{path}/{self.slice}.{r}.counts") as file:
                self.tables[r] = pa.ipc.open_file(file).read_all()
        got = [unpacked(t, m) for h, m, t in zip(*(self.tables[r].column(c).to_pylist() for c in ("half", "n", "times"))) if h == f]
        if sum(map(len, got)) != n:
            raise ValueError("the counts of a slice are not those of its words")
        return np.concatenate(got).astype(np.float64)


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight one after another, compressed."""
    v = np.ascontiguousarray(values, "<u8")
    return pa.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(v) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    return np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<u8").ravel()


def name(part, text: str, lang: np.ndarray) -> int:
    """A slice's number, from what it holds: a slice that is cut otherwise when read again is not found."""
    data, rows = blocks.buffers(part.column(text))
    h = blocks.mix(blocks.hash_words_long(data, rows) + np.arange(len(lang), dtype=np.uint64))
    spelled = blocks.hash_words(pa.array([str(x).encode() for x in lang], pa.large_binary()))
    return int(blocks.mix(np.array([np.bitwise_xor.reduce(h) ^ blocks.mix(spelled + np.arange(len(lang), dtype=np.uint64)).sum(dtype=np.uint64)]))[0].astype(np.int64))


def homes(df: DataFrame, text: str) -> int:
    size = df.agg(F.coalesce(F.sum(F.octet_length(f"`{text}`").cast("long")), F.lit(0))).first()[0]
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // HOME_BYTES)


def cut(column: pa.Array) -> stats.Words:
    """The words of a column, without their lines."""
    flat, rows = blocks.words(column, blocks.BLANK_WORDS)
    codes, distinct = blocks.coded(flat)
    return stats.Words(codes, distinct, rows, None, None)


def count(df: DataFrame, lang: str, text: str) -> str:
    """Count n-grams and write the counts that each slice of ``df`` asks for; their folder."""
    folder = shared.scratch(df.sparkSession, "words")
    n_homes = homes(df, text)
    with shared.passing(df.sparkSession):
        for r in range(len(ROUNDS)):
            ask(df, lang, text, folder, n_homes, r)
    return folder


def ask(df: DataFrame, lang: str, text: str, folder: str, n_homes: int, r: int) -> None:
    """One round: count the n-grams of its orders that may be in both halves."""
    def send(batches):
        for part in blocks.slices(batches, text):
            langs = np.array(part.column(lang).to_pylist(), object)
            slice_ = name(part, text, langs)
            for half in halves(part, text, cut(part.column(text)), langs, folder, r)[2]:
                distinct, times = half.distinct, half.times.astype(np.uint64)
                home = (distinct * np.uint64(n_homes) >> np.uint64(KEY_BITS)).astype(np.int64)
                first = np.flatnonzero(np.diff(home, prepend=-1))
                rows = [(int(home[a]), a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(home)])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([h for h, _, _ in rows], pa.int32()), pa.array([slice_] * len(rows), pa.int64()), pa.array([half.f] * len(rows), pa.int32()),
                    pa.array([b - a for _, a, b in rows], pa.int32()),
                    pa.array([packed(np.diff(distinct[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
                    pa.array([packed(times[a:b]) for _, a, b in rows], pa.binary())], names=["home", "slice", "half", "n", "keys", "times"])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = [(s, f, n, np.cumsum(unpacked(k, n), dtype=np.uint64), t) for s, f, n, k, t in zip(
            *(table.column(c).to_pylist() for c in ("slice", "half", "n", "keys", "times")))]
        known = []
        for f in (0, 1):
            mine = [r for r in rows if r[1] == f]
            k, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[3] for r in mine)]), return_inverse=True)
            known.append((k, np.bincount(of, np.concatenate([np.zeros(0), *(unpacked(r[4], r[2]) for r in mine)]), len(k)).astype(np.uint64)))
        out = []
        for _, f, n, k, _ in rows:
            have, times = known[1 - f]
            at = np.minimum(np.searchsorted(have, k), max(0, len(have) - 1))
            out.append(packed(np.where(have[at] == k, times[at], 0) if len(have) else np.zeros(n, np.uint64)))
        return pa.table({"slice": table.column("slice"), "half": table.column("half"), "home": table.column("home"), "n": table.column("n"), "times": pa.array(out, pa.binary())})

    def file(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("half", "ascending"), ("home", "ascending")])
        place = table.column("half").to_numpy().astype(np.int64) << 32 | table.column("home").to_numpy()
        table = table.filter(pa.array(np.diff(place, prepend=-1) > 0))  # equal slices, as of a copied file, were answered alike
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        store.put(folder, f"{key[0].as_py()}.{r}.counts", [sink.getvalue()])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64())})

    sent = df.mapInArrow(send, "home int, slice long, half int, n int, keys binary, times binary")
    made = sent.groupBy("home").applyInArrow(answer, "slice long, half int, home int, n int, times binary")
    made.groupBy("slice").applyInArrow(file, "slice long").write.format("noop").mode("overwrite").save()


def score(folder: str, part, text: str, lang: np.ndarray, words, spelled: np.ndarray) -> np.ndarray:
    """Mean negative log probability of the words of each row; NaN without words. ``spelled``: log probability of each word's spelling."""
    total = np.zeros(len(lang))
    row, place, made = halves(part, text, words, lang, folder, len(ROUNDS))
    for half in made:
        real = np.flatnonzero(place[half.mine] >= 0)  # an edge comes before every word of its row
        p = np.exp(spelled[place[half.mine][real]])
        for k in range(1, ORDERS):
            p = (half.known[k][real] + PRIOR * p) / (half.known[k - 1][half.back[real]] + PRIOR)
        total += np.bincount(row[half.mine][real], -np.log(np.maximum(p, 1e-300)), len(lang))
    n = np.diff(words.rows)
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)
