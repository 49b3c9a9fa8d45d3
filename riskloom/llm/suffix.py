"""Removal of passages that occur in an earlier document, by longest-previous-factor arrays.

A passage is a string of ``LENGTH`` bytes; it is removed wherever an equal string starts in a document with a
smaller id. Each such string holds an anchor, the K-gram of least hash among its W, and equal strings
have equal anchors. So occurrences meet in the bucket of their anchor, and a suffix array is only
needed over the surroundings of one anchor, LENGTH bytes around it:

1. Tasks find anchors and the hash of each one's surroundings. Equal surroundings merge to that of the least
   document; all others are covered. What is left of a task goes to the anchors' buckets, where the same is done.
2. Anchors that still have different surroundings in different documents come back to their texts, which give
   the bytes. Over these a suffix array is sorted; previous and next smaller documents in
   suffix order give each string's longest previous factor, and it is covered if that is a whole passage. Of very
   frequent anchors the strings are dealt out one by one, by their own hash, and equal ones merge first.
3. Covered bytes of a document are united and cut out.

Every exchange is dealt by hashes into buckets whose number grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm import blocks
from riskloom.sources import shared

LENGTH, K = 50, 24
W = LENGTH - K + 1
SIDE = W - 1  # bytes on each side of an anchor that strings with it can reach
GAP = 64  # zero bytes between texts, so that no read of a word crosses into another text
BUCKET_BYTES = 16 << 20
FEWEST = 64
HOT = 2000  # different surroundings of an anchor from which strings are dealt one by one
COVERED, PARTLY, FREQUENT = 0, 1, 2
C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def padded(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with gaps before, between and after, and where each begins and ends."""
    size = np.diff(rows)
    begin = GAP + rows[:-1] + GAP * np.arange(len(size))
    out = np.zeros(len(data) + GAP * (len(size) + 1) + 8, np.uint8)
    out[np.arange(len(data)) + np.repeat(begin - rows[:-1], size)] = data
    return out, begin, begin + size


def words_at(buffer: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8-byte word at every position, as a view."""
    return np.ndarray((len(buffer) - 7,), kind, buffer, strides=(1,))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, text, hash and hash of the surroundings of each anchor."""
    w = words_at(buffer)
    h = w[:-16] * C[0]
    h ^= h >> np.uint64(31)
    h += w[8:-8]
    h *= C[1]
    h ^= h >> np.uint64(29)
    h += w[16:]
    h *= C[2]
    h ^= h >> np.uint64(32)
    n = len(h) - W + 1
    edge = np.zeros(n + 1, np.int8)
    long = end - begin >= LENGTH
    edge[begin[long]] += 1
    edge[end[long] - LENGTH + 1] -= 1
    least = _slide(h, W, np.minimum)
    least[np.cumsum(edge[:n]) == 0] = 0
    reach = _slide(np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)]), W, np.maximum)
    at = np.flatnonzero((reach == h) & (h > 0))
    text = np.searchsorted(begin, at, side="right") - 1
    around = (np.minimum(SIDE, at - begin[text]) * 32 + np.minimum(SIDE, end[text] - at - K)).astype(np.uint64)
    for k in (-SIDE, 8 - SIDE, 16 - SIDE, -8, K, K + 8, K + 16, K + SIDE - 8):
        around = blocks.mix((around + C[0]) ^ w[at + k])
    return at - begin[text], text, h[at], around


def least_of(*keys: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and value, group number of each entry in that order, least value of each group."""
    order = np.lexsort((value, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.cumsum(new) - 1, value[order][new]


ENTRY = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("at", "<u4"), ("kind", "u1"), ("hash", "<u8")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("a", "<u4"), ("b", "<u4")])
FACTOR = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("at", "<u4"), ("size", "u1"), ("one", "?")])


def pack(array: np.ndarray) -> bytes:
    """Column by column, so that what repeats packs well."""
    raw = b"".join(np.ascontiguousarray(array[f]).tobytes() for f in array.dtype.names)
    return len(array).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(raws: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = [np.zeros(0, dtype)]
    for raw in raws:
        n = int.from_bytes(raw[:4], "little")
        plain, part, at = zstandard.ZstdDecompressor().decompress(raw[4:]), np.zeros(n, dtype), 0
        for f in dtype.names:
            part[f] = np.frombuffer(plain, dtype[f], n, at)
            at += n * dtype[f].itemsize
        out.append(part)
    return np.concatenate(out)


def deal(array: np.ndarray, to: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, packed entries) of each bucket that has some."""
    order = np.argsort(to, kind="stable")
    bucket, at = np.unique(to[order], return_index=True)
    return [(int(b), pack(array[order[x:y]])) for b, x, y in zip(bucket, at, [*at[1:], len(order)])]


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "packed": pa.binary(), "bytes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[n]) for k, n in enumerate(names)], names=names)


def home(doc: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    return (blocks.mix(doc.astype(np.uint64) ^ (tie.astype(np.uint64) << np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def ties(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """32 bits that tell texts under the same id apart."""
    return (blocks.hash_words_long(data, rows) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


ANCHOR = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("at", "<u4"), ("hash", "V6"), ("around", "V6")])


def short(h: np.ndarray) -> np.ndarray:
    """The upper 48 bits of hashes."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:]).view("V6").reshape(-1)


def long(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), 8), np.uint8)
    out[:, :6] = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def find_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1 in tasks: (bucket, kind, packed) with covered entries for the texts' homes and anchors for the buckets."""
    def flush(held):
        doc, tie, at, h, around = (np.concatenate(x) for x in zip(*held))
        order, group, least = least_of(h, around, value=doc)
        doc, tie, at, h, around = doc[order], tie[order], at[order], h[order], around[order]
        done = doc > least[group]
        back = np.zeros(int(done.sum()), ENTRY)
        back["doc"], back["tie"], back["at"], back["kind"] = doc[done], tie[done], at[done], COVERED
        rows = [(b, 0, p) for b, p in deal(back, home(back["doc"], back["tie"], buckets))]
        left = np.zeros(int((~done).sum()), ANCHOR)
        left["doc"], left["tie"], left["at"] = doc[~done], tie[~done], at[~done]
        left["hash"], left["around"] = short(h[~done]), short(around[~done])
        order = np.lexsort((left["at"], left["doc"]))
        return _batch(rows + [(b, 1, p) for b, p in deal(left[order], (h[~done][order] % np.uint64(buckets)).astype(np.int64))], "bucket kind packed")

    def run(batches):
        held, size = [], 0
        for part in blocks.slices(batches, "_text", 1 << 20):
            data, rows = blocks.buffers(part.column("_text"))
            tie = ties(data, rows)
            at, text, h, around = anchors(*padded(data, rows))
            doc = part.column("_id").to_numpy(zero_copy_only=False)
            held.append((doc[text], tie[text], at, h, around))
            size += len(data)
            if size >= 8 << 20:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.where("_id IS NOT NULL").select("_id", "_text").mapInArrow(run, "bucket int, kind int, packed binary")


def judge(found: DataFrame, buckets: int) -> DataFrame:
    """Step 1 in buckets: (bucket, packed) entries for the homes of texts; what was settled in tasks passes through."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        mine = table.filter(pc.equal(table.column("kind"), 1)).column("packed").to_pylist()
        through = table.filter(pc.equal(table.column("kind"), 0)).select(["bucket", "packed"])
        e = unpack(mine, ANCHOR)
        hashes = long(e["hash"])
        order, group, least = least_of(hashes, long(e["around"]), value=e["doc"])
        e, hashes = e[order], hashes[order]
        covered = e["doc"] > least[group]
        first = np.flatnonzero(np.diff(np.concatenate([[-1], group])))
        if not len(e):
            return through
        anchor = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1
        of = anchor[first]  # anchor of each group of equal surroundings
        start = np.flatnonzero(np.diff(np.concatenate([[-1], of])))
        several = np.minimum.reduceat(least, start) < np.maximum.reduceat(least, start)
        many = np.diff(np.append(start, len(of))) > HOT
        out = np.zeros(len(e), ENTRY)
        for f in ("doc", "tie", "at"):
            out[f] = e[f]
        out["hash"] = hashes
        out["kind"] = np.where(covered, COVERED, np.where(many[anchor], FREQUENT, PARTLY))
        out = out[covered | several[anchor]]
        out["hash"][out["kind"] == COVERED] = 0
        out = out[np.lexsort((out["at"], out["doc"]))]
        made = _batch(deal(out, home(out["doc"], out["tie"], buckets)), "bucket packed")
        return pa.concat_tables([through, pa.Table.from_batches([made])])

    return found.groupBy("bucket").applyInArrow(run, "bucket int, packed binary")


def _keys(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    key = np.zeros(len(doc), [("doc", "<i8"), ("tie", "<u4")])
    key["doc"], key["tie"] = doc, tie
    return key


def _rows(table: pa.Table) -> pa.Table:
    """The rows that were packed for a home."""
    unzip = zstandard.ZstdDecompressor()
    return pa.concat_tables(pa.ipc.open_stream(unzip.decompress(z)).read_all() for z in table.column("_rows").to_pylist()) if table.num_rows else None


def _texts(rows: pa.Table | None) -> tuple[list[bytes], np.ndarray]:
    """Texts and (id, tie) keys of a home's rows; those without an id have that of 0, but are never asked for."""
    if rows is None:
        return [], _keys(np.zeros(0, np.int64), np.zeros(0, np.uint32))
    texts = [t or b"" for t in rows.column("_text").cast(pa.large_binary()).to_pylist()]
    return texts, _keys(rows.column("_id").fill_null(0).to_numpy().astype(np.int64), rows.column("_tie").to_numpy().astype(np.uint32))


def surroundings(zipped: DataFrame, entries: DataFrame, buckets: int) -> DataFrame:
    """Step 2 at the texts: (bucket, kind, packed, bytes) with covered spans (kind 0) and strings for suffix arrays (kind 1)."""
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        texts, keys = _texts(_rows(left))
        e = unpack(right.column("packed").to_pylist(), ENTRY)
        known, first = np.unique(keys, return_index=True)
        row = first[np.searchsorted(known, _keys(e["doc"], e["tie"]))] if len(e) else np.zeros(0, np.int64)
        size = np.array([len(t) for t in texts], np.int64)[row] if len(e) else row
        a, b = np.maximum(e["at"].astype(np.int64) - SIDE, 0), np.minimum(e["at"].astype(np.int64) + K + SIDE, size)
        done = e["kind"] == COVERED
        span = np.zeros(int(done.sum()), SPAN)
        span["doc"], span["tie"], span["a"], span["b"] = e["doc"][done], e["tie"][done], a[done], b[done]
        rows = [(key[0].as_py(), 0, pack(merge(span)), b"")] if len(span) else []
        made: list[tuple[int, tuple, bytes]] = []
        seen: dict[bytes, int] = {}
        again = []
        todo = np.flatnonzero(~done)
        for k in todo[np.argsort(e["doc"][todo], kind="stable")].tolist():
            x, y, doc, tie = int(a[k]), int(b[k]), int(e["doc"][k]), int(e["tie"][k])
            raw = texts[row[k]][x:y]
            if e["kind"][k] == PARTLY:
                made.append((int(e["hash"][k]) % buckets, (doc, tie, x, len(raw), False), raw))
                continue
            for i in range(max(0, int(e["at"][k]) + K - LENGTH - x), min(int(e["at"][k]) - x, len(raw) - LENGTH) + 1):
                one = raw[i:i + LENGTH]
                if seen.setdefault(one, doc) < doc:
                    again.append((doc, tie, x + i, x + i + LENGTH))
                else:
                    made.append((-1, (doc, tie, x + i, LENGTH, True), one))
        if again:
            rows.append((key[0].as_py(), 0, pack(merge(np.array(again, SPAN))), b""))
        if made:
            to = np.array([m[0] for m in made], np.int64)
            lone = np.flatnonzero(to < 0)
            if len(lone):
                flat = np.frombuffer(b"".join(made[k][2] for k in lone), np.uint8)
                to[lone] = (blocks.hash_words_long(flat, np.arange(len(lone) + 1) * LENGTH) % np.uint64(buckets)).astype(np.int64)
            meta = np.array([m[1] for m in made], FACTOR)
            order = np.argsort(to, kind="stable")
            bucket, at = np.unique(to[order], return_index=True)
            zip_ = zstandard.ZstdCompressor(level=1)
            for t, x, y in zip(bucket, at, [*at[1:], len(order)]):
                rows.append((int(t), 1, pack(meta[order[x:y]]), zip_.compress(b"".join(made[k][2] for k in order[x:y]))))
        return pa.Table.from_batches([_batch(rows, "bucket kind packed bytes")])

    cogroup = zipped.groupBy("_home").cogroup(entries.groupBy("bucket"))
    return cogroup.applyInArrow(run, "bucket int, kind int, packed binary, bytes binary")


def suffix_array(buffer: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``start`` by their first LENGTH bytes, and the bytes each shares with the one before.

    Shared bytes are told in whole words of eight, or LENGTH.
    """
    w = words_at(buffer, ">u8")
    places = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    columns = [w[start + k].astype(np.uint64) for k in places]
    order = np.lexsort(columns[::-1])
    shared_ = np.full(len(order), LENGTH)
    for k, column in reversed(list(zip(places, columns))):
        sorted_ = column[order]
        shared_[1:][sorted_[1:] != sorted_[:-1]] = min(k, LENGTH - 8)
    if len(order):
        shared_[0] = 0
    return order, shared_


def previous_factors(doc: list[int], common: list[int]) -> list[int]:
    """Longest previous factors of suffixes in suffix order, by the nearest smaller documents before and after.

    ``common[i]`` is what suffixes i - 1 and i share. The stack holds documents that grow, with what each shares
    with the one below it.
    """
    n = len(doc)
    best = [0] * n
    for forward in (True, False):
        docs, least = [], []
        for i in range(n) if forward else range(n - 1, -1, -1):
            now = common[i] if forward else (common[i + 1] if i + 1 < n else 0)
            mine = doc[i]
            while docs and docs[-1] >= mine:
                docs.pop()
                now = min(now, least.pop())
            if docs and now > best[i]:
                best[i] = now
            docs.append(mine)
            least.append(now)
    return best


def covered(factors: DataFrame, buckets: int) -> DataFrame:
    """Step 2 in buckets: (bucket, packed) spans that previous factors cover, for the homes of texts."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        meta = unpack(table.column("packed").to_pylist(), FACTOR)
        unzip = zstandard.ZstdDecompressor()
        flat = np.frombuffer(b"".join(map(unzip.decompress, table.column("bytes").to_pylist())) + bytes(8), np.uint8)
        size = meta["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        of = np.repeat(np.arange(len(meta)), count)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[of] + offset
        # Only strings that another one may equal need sorting.
        w = words_at(flat)
        h = np.zeros(len(start), np.uint64)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            h = blocks.mix((h + C[0]) ^ w[start + k])
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[which] > 1)
        order, common = suffix_array(flat, start[some])
        some = some[order]
        long = previous_factors(meta["doc"][of[some]].tolist(), common.tolist())
        hit = some[np.array(long, np.int64) >= LENGTH] if len(some) else some
        low, high = np.full(len(meta), 255), np.full(len(meta), -1)
        np.minimum.at(low, of[hit], offset[hit])
        np.maximum.at(high, of[hit], offset[hit])
        got = np.flatnonzero(high >= 0)
        span = np.zeros(len(got), SPAN)
        span["doc"], span["tie"] = meta["doc"][got], meta["tie"][got]
        span["a"], span["b"] = meta["at"][got] + low[got], meta["at"][got] + high[got] + LENGTH
        return pa.Table.from_batches([_batch(deal(span, home(span["doc"], span["tie"], buckets)), "bucket packed")])

    return factors.groupBy("bucket").applyInArrow(run, "bucket int, packed binary")


def merge(span: np.ndarray) -> np.ndarray:
    """Spans united to maximal runs, in order of document and place."""
    if not len(span):
        return span
    span = span[np.lexsort((span["a"], span["tie"], span["doc"]))]
    row = np.cumsum(np.concatenate([[True], (span["doc"][1:] != span["doc"][:-1]) | (span["tie"][1:] != span["tie"][:-1])])).astype(np.int64) << 33
    a, b = span["a"] + row, np.maximum.accumulate(span["b"] + row)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    out = span[new]
    out["b"] = (b - row)[np.append(new[1:], len(span)) - 1]
    return out


def cut(zipped: DataFrame, spans: DataFrame, columns: list[str], schema: T.StructType, as_text: bool) -> DataFrame:
    """Step 3: ``columns`` with n_bytes, spans and what is kept, as bytes and perhaps as text."""
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows(left)
        if rows is None:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        texts, keys = _texts(rows)
        null = rows.column("_id").is_null().to_pylist()
        s = merge(unpack(right.column("packed").to_pylist(), SPAN))
        known, at = np.unique(_keys(s["doc"], s["tie"]), return_index=True)
        place = np.searchsorted(known, keys)
        at = [*at.tolist(), len(s)]
        kept, runs = [], []  # of each row
        for k, text in enumerate(texts):
            p = place[k]
            if null[k] or p == len(known) or known[p] != keys[k]:
                kept.append(text)
                runs.append([])
                continue
            mine = s[at[p]:at[p + 1]]
            a, b = mine["a"].tolist(), mine["b"].tolist()
            kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])))
            runs.append([{"first": x, "last": y - 1} for x, y in zip(a, b)])
        made = [pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(kept, pa.binary())]
        if as_text:
            made.append(pa.array([raw.decode(errors="ignore") for raw in kept], pa.string()))
        return pa.Table.from_arrays([*(rows.column(f"c{k}") for k in range(len(columns))), *made], names=names)

    names = [*(f"c{k}" for k in range(len(columns))), *schema.names[len(columns):]]
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    return zipped.groupBy("_home").cogroup(spans.groupBy("bucket")).applyInArrow(run, out).toDF(*schema.names)


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, as_text: str | None = None) -> DataFrame:
    """``keep`` (all columns but ``text`` by default), n_bytes, removed (byte runs, first and last) and kept (bytes).

    ``as_text`` names a further column with the kept text, without bytes of characters that were cut through.

    Null texts are empty. Documents with equal keys do not cover each other; rows without a key are neither
    searched nor covered. Matches never cross documents. A column of an added name is replaced.
    """
    added = T.StructType([T.StructField("n_bytes", T.LongType()),
                          T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
                          T.StructField("kept", T.BinaryType())])
    if as_text:
        added = added.add(as_text, T.StringType())
    columns = [c for c in (df.columns if keep is None else keep) if c != text and c not in added.names]
    docs = df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(FEWEST, int(total) // BUCKET_BYTES)

    def zip_rows(batches):
        """Rows packed for their homes, so that little travels."""
        pack_ = zstandard.ZstdCompressor(level=5)
        for part in blocks.slices(batches, "_text", 2 * blocks.SLICE_BYTES):
            data, rows = blocks.buffers(part.column("_text"))
            tie = ties(data, rows)
            part = part.append_column("_tie", pa.array(tie, pa.uint32()))
            to = home(part.column("_id").fill_null(0).to_numpy(zero_copy_only=False), tie, buckets)
            order = np.argsort(to, kind="stable")
            name, at = np.unique(to[order], return_index=True)
            made = []
            for x, y in zip(at, [*at[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part.take(pa.array(order[x:y])))
                made.append(pack_.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(made, pa.binary())], names=["_home", "_rows"])

    zipped = docs.mapInArrow(zip_rows, "_home int, _rows binary")
    with shared.scope(df.sparkSession) as stay:
        entries = judge(find_anchors(docs, buckets), buckets)
        around = shared.materialize(surroundings(zipped, entries, buckets))
        stay.append(around)
    spans = around.where("kind = 0").select("bucket", "packed").union(covered(around.where("kind = 1").select("bucket", "packed", "bytes"), buckets))
    return cut(zipped, spans, columns, T.StructType([*(df.schema[c] for c in columns), *added]), bool(as_text))
