"""Token ids in files of a static range asymmetric numeral system (rANS).

One table of frequencies, counted over the corpus, is shared by all files. A file is a run of blocks
that can be decoded alone; in a block, ``LANES`` coder states take tokens in turn and write to one
stream of 32-bit words. Every ``CHECK`` turns the states and the place in the stream are noted, so
decoding can start at each note, and all notes of a file are decoded side by side. Blocks carry a
checksum of their tokens.

File: head (magic, documents, tokens, blocks, crc of the frequency table), document ids (int64), token
counts (uint32), block index (byte offset, words, crc of tokens), crc of all that; then the blocks:
notes (word position uint32, LANES states uint64) and words (uint32). Little-endian throughout.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import blocks, store
from riskloom.sources import shared

LANES, TURNS, CHECK = 64, 1024, 256
BLOCK = LANES * TURNS
NOTES = TURNS // CHECK
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
WORD = np.uint64(32)
MASK = np.uint64(0xFFFFFFFF)
HEAD = struct.Struct("<4sQQIII")
MAGIC = b"RNS1"
NOTE = np.dtype([("at", "<u4"), ("state", "<u8", LANES)])
INDEX = np.dtype([("offset", "<u8"), ("words", "<u4"), ("crc", "<u4")])
AT_ONCE = 32  # blocks coded side by side
NO_KEY = -(1 << 63)
SPLIT = 2_000_000  # tokens that one reading task takes, or up to a quarter more
SLICE_BYTES = 2 << 20  # text encoded at once in a task
SENT = 100_000  # tokens that a reading task hands over at once


def turns_of(size: np.ndarray) -> np.ndarray:
    """Turns in which a block of so many tokens is coded; its last one is filled up."""
    return -(-size // LANES)


class Frequencies:
    """Counts of symbols 0..n-1, scaled to a power of two; a symbol that occurs keeps at least one slot."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        used = counts > 0
        self.bits = max(12, int(np.ceil(np.log2(max(2, used.sum())))) + 2)
        total = 1 << self.bits
        f = np.where(used, np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * total)), 0).astype(np.int64)
        if not used.any():
            f = np.zeros(max(1, len(counts)), np.int64)
            f[0] = total
        while (rest := total - int(f.sum())) != 0:  # settle rounding on the largest, which change least by it
            top = int(f.argmax())
            f[top] += rest if rest > 0 else -min(-rest, max(1, int(f[top]) // 2))
        self.f = f.astype(np.uint64)
        self.cum = (np.cumsum(f) - f).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        self.crc = zlib.crc32(f.astype("<u4").tobytes())

    def encode(self, tokens: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        """(block bytes, words, crc of tokens) of each block."""
        bits, filler = np.uint64(self.bits), np.uint32(self.f.argmax())
        for a in range(0, len(tokens), BLOCK * AT_ONCE):
            part = tokens[a:a + BLOCK * AT_ONCE]
            if part.size and (int(part.max()) >= len(self.f) or (self.f[part] == 0).any()):
                raise ValueError("a token that the frequency table does not hold")
            n = -(-len(part) // BLOCK)
            grid = np.full(n * BLOCK, filler, np.uint32)
            grid[:len(part)] = part
            turns = turns_of(np.minimum(BLOCK, len(part) - BLOCK * np.arange(n)))[:, None]
            grid = grid.reshape(n, TURNS, LANES)
            state = np.full((n, LANES), LOW, np.uint64)
            out, emit = np.empty((TURNS, n, LANES), np.uint32), np.zeros((TURNS, n, LANES), bool)
            saved = np.empty((NOTES, n, LANES), np.uint64)
            for turn in range(TURNS - 1, -1, -1):
                s = grid[:, turn]
                f = self.f[s]
                live = turn < turns
                full = live & (state >= (f << (np.uint64(63) - bits)))
                out[turn], emit[turn] = state & MASK, full
                state = np.where(full, state >> WORD, state)
                q = state // f
                state = np.where(live, (q << bits) + (state - q * f) + self.cum[s], state)
                if turn % CHECK == 0:
                    saved[turn // CHECK] = state
            for b in range(n):
                words = out[:, b][emit[:, b]].astype("<u4")
                note = np.zeros(NOTES, NOTE)
                note["state"] = saved[:, b]
                note["at"][1:] = np.cumsum(emit[:, b].reshape(NOTES, -1).sum(1))[:-1]
                yield note.tobytes() + words.tobytes(), len(words), zlib.crc32(part[b * BLOCK:(b + 1) * BLOCK].astype("<u4").tobytes())

    def decode(self, parts: list[tuple[bytes, int, int]], sizes: list[int]) -> np.ndarray:
        """Tokens of blocks of the given sizes; raises if a checksum differs."""
        bits, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        done = []
        for a in range(0, len(parts), AT_ONCE):
            some = parts[a:a + AT_ONCE]
            notes = np.concatenate([np.frombuffer(raw, NOTE, NOTES) for raw, _, _ in some])
            stream = np.concatenate([np.frombuffer(raw, "<u4", count, NOTES * NOTE.itemsize) for raw, count, _ in some] + [np.zeros(1, "<u4")]).astype(np.uint64)
            base = np.concatenate([[0], np.cumsum([count for _, count, _ in some])])[:-1]
            at = notes["at"].astype(np.int64) + np.repeat(base, NOTES)
            state = notes["state"].astype(np.uint64)
            out = np.empty((len(notes), CHECK, LANES), np.uint32)
            turns = np.repeat(turns_of(np.array(sizes[a:a + AT_ONCE])), NOTES)[:, None] - CHECK * (np.arange(len(notes)) % NOTES)[:, None]
            for turn in range(CHECK):
                slot = state & low
                s = self.symbol[slot]
                out[:, turn] = s
                live = turn < turns
                state = np.where(live, self.f[s] * (state >> bits) + slot - self.cum[s], state)
                short = live & (state < LOW)
                place = np.cumsum(short, axis=1) + (at[:, None] - 1)
                state = np.where(short, state << WORD | stream[np.minimum(np.where(short, place, -1), len(stream) - 1)], state)
                at += short.sum(1)
            grid = out.reshape(len(some), BLOCK)
            for k, (_, _, crc) in enumerate(some):
                tokens = grid[k, :sizes[a + k]]
                if zlib.crc32(tokens.astype("<u4").tobytes()) != crc:
                    raise ValueError("a block's checksum differs")
                done.append(tokens)
        return np.concatenate(done) if done else np.zeros(0, np.uint32)


def write_file(folder: str, name: str, table: Frequencies, doc_ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> None:
    coded = list(table.encode(tokens))
    index = np.zeros(len(coded), INDEX)
    index["words"], index["crc"] = [w for _, w, _ in coded], [c for _, _, c in coded]
    size = np.array([len(raw) for raw, _, _ in coded], np.int64)
    index["offset"] = np.cumsum(size) - size + HEAD.size + 12 * len(doc_ids) + index.nbytes + 4
    head = HEAD.pack(MAGIC, len(doc_ids), len(tokens), len(coded), table.crc, LANES) + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + index.tobytes()
    store.put(folder, name, [head, struct.pack("<I", zlib.crc32(head)), *(raw for raw, _, _ in coded)])


def read_file(folder: str, name: str, table: Frequencies, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents that begin in one of ``parts`` equal shares of the file: ids, first token in the file, counts, tokens."""
    fs, path = store.at(f"{folder.rstrip('/')}/{name}")
    with fs.open_input_file(path) as f:
        head = f.read(HEAD.size)
        magic, docs, total, n, crc, lanes = HEAD.unpack(head)
        if magic != MAGIC or lanes != LANES or crc != table.crc:
            raise ValueError(f"{name} is of another format or frequency table")
        rest = f.read(12 * docs + n * INDEX.itemsize + 4)
        if zlib.crc32(head + rest[:-4]) != struct.unpack("<I", rest[-4:])[0]:
            raise ValueError(f"the head of {name} has another checksum")
        ids, counts = np.frombuffer(rest, "<i8", docs), np.frombuffer(rest, "<u4", docs, 8 * docs).astype(np.int64)
        index = np.frombuffer(rest, INDEX, n, 12 * docs)
        first = np.cumsum(counts) - counts
        a, b = np.searchsorted(first, [part * total // parts, (part + 1) * total // parts if part + 1 < parts else total + 1])
        ids, counts, first = ids[a:b], counts[a:b], first[a:b]
        if not len(ids):
            return ids, first, counts, np.zeros(0, np.uint32)
        lo, hi = int(first[0]) // BLOCK, -(-int(first[-1] + counts[-1]) // BLOCK)
        raw = []
        for k in range(lo, hi):
            f.seek(int(index[k]["offset"]))
            raw.append((f.read(NOTES * NOTE.itemsize + 4 * int(index[k]["words"])), int(index[k]["words"]), int(index[k]["crc"])))
    tokens = table.decode(raw, [min(BLOCK, total - k * BLOCK) for k in range(lo, hi)])
    return ids, first, counts, tokens[int(first[0]) - lo * BLOCK:int(first[-1] + counts[-1]) - lo * BLOCK]


def _kinds() -> np.ndarray:
    """Of each byte: 0 not plain, 1 letter, 2 digit, 3 mark. The apostrophe is not plain, as the tokenizer keeps endings like 's together."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = 3
    out[ord("'")] = 0
    out[ord("0"):ord("9") + 1] = 2
    out[ord("A"):ord("Z") + 1] = out[ord("a"):ord("z") + 1] = 1
    return out


KINDS = _kinds()
LATIN = 0xC3  # first byte of U+00C0 to U+00FF, all of them letters but for two signs


def cut(flat: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of words given one after another, and the piece at which each row starts.

    A word is plain if it holds ASCII letters, digits and marks, and letters of U+00C0 to U+00FF, without an apostrophe and without what may
    begin a special token. Plain words are folded to lower case.
    """
    if not len(flat):
        return flat, rows
    data, cuts = blocks.buffers_of(flat)
    kind = KINDS[data]
    lead = np.flatnonzero(data[:-1] == LATIN)
    letter = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[letter] = kind[letter + 1] = 1
    begins = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[begins] = 0
    strange = np.concatenate([[0], np.cumsum(kind == 0)])
    plain = np.repeat(strange[cuts[1:]] == strange[cuts[:-1]], np.diff(cuts))
    low = blocks.LOWER[data]
    upper = letter[(data[letter + 1] < 0x9F)]
    low[upper + 1] += 0x20
    first = np.zeros(len(data), bool)
    first[1:] = plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    first[cuts[:-1]] = True
    starts = np.flatnonzero(first)
    return blocks.strings(np.where(plain, low, data), np.append(starts, len(data))), np.searchsorted(starts, cuts[rows])


class Known:
    """Distinct pieces, and their ids one after another."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece; -1 if it is not known."""
        return np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.at.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.ids)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered pieces one after another, and where each piece's begin."""
        n = self.size[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.begin[at] - upto[:-1], n) + np.arange(upto[-1])], upto


class Words:
    """Ids of a tokenizer that never joins what blanks part, found once for each distinct piece of a word.

    Words of plain bytes (:func:`cut`) are folded and cut into runs of letters, single digits and runs of marks, as the tokenizer cuts
    them itself; there are far fewer such pieces than words. Other words are pieces as they stand.
    Most words go to the library many at a time. Where the tokens of a piece of such a text end is told by the
    end-of-word sign of the vocabulary and by how many pieces the split pattern makes of each word; words for
    which that is not plain, and texts whose count comes out different, are encoded one by one.
    Beyond ``CACHED`` pieces a new table is begun; the one before it is still asked, so that frequent pieces are not found anew.
    """

    CACHED, TOGETHER = 450_000, 1000
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        probe = "it's  1st\tWord\n<|endoftext|>x, naïve"
        if self.alone([probe])[0] != [i for r in self.alone(probe.split()) for i in r]:
            raise ValueError("this tokenizer does not treat words alone")
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known, self.older = Known(), Known()

    def alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    @classmethod
    def pieces(cls, word: str) -> int:
        """How many pieces the tokenizer splits a word into; 0 if that is not plain."""
        if word.isascii():
            if word.isalpha():
                return 1
            return len(cls.SPLIT.findall(word.lower())) if word.isprintable() and "<|" not in word else 0
        return int(word.isalpha() and word.lower().isalpha() and unicodedata.is_normalized("NFC", word))

    def several(self, words: list[str], pieces: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words one after another, and how many each has."""
        ids = np.array(self.alone([" ".join(words)])[0], np.int32)
        end, upto = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(pieces)
        if len(end) == upto[-1] and end[-1] == len(ids):
            return ids, np.diff(end[upto - 1], prepend=0)
        return self.joined(self.alone(words))

    @staticmethod
    def joined(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each], np.int64)

    def learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        pieces = list(map(self.pieces, words))
        plain, rest = [k for k, n in enumerate(pieces) if n], [k for k, n in enumerate(pieces) if not n]
        made = [self.joined(self.alone([words[k] for k in rest]))]
        for a in range(0, len(plain), self.TOGETHER):
            some = plain[a:a + self.TOGETHER]
            made.append(self.several([words[k] for k in some], [pieces[k] for k in some]))
        self.known.add([new[k] for k in [*rest, *plain]], np.concatenate([i for i, _ in made]), np.concatenate([n for _, n in made]))

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        flat, rows = blocks.words(column, blocks.BLANK_WORDS)
        pieces, rows = cut(flat, rows)
        codes, distinct = blocks.coded(pieces)
        distinct = distinct.to_numpy(zero_copy_only=False)
        if len(self.known.at) > self.CACHED:
            self.known, self.older = Known(), self.known
        at = self.known.find(distinct.tolist())
        if len(missing := np.flatnonzero(at < 0)):
            new = distinct[missing]
            was = self.older.find(new.tolist())
            again = was >= 0
            ids, upto = self.older.of(was[again])
            self.known.add(new[again].tolist(), ids, np.diff(upto))
            self.learn(new[~again].tolist())
            at[missing] = self.known.find(new.tolist())
        ids, upto = self.known.of(at[codes])
        return blocks.ended(ids, upto[rows], end)


@lru_cache(2)
def tokenizer(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def encode(df: DataFrame, model: str, end: int, key: str, text: str) -> DataFrame:
    """(key, tie, ids): the token ids of every text, packed."""
    def run(batches):
        t = tokenizer(model)
        for part in blocks.slices(batches, text, SLICE_BYTES):
            flat, offsets = t.encode(part.column(text), end)
            pack = zstandard.ZstdCompressor(level=1)
            raw = flat.astype("<u4" if flat.size and int(flat.max()) > 0xFFFF else "<u2")
            ids = [bytes([raw.itemsize]) + pack.compress(raw[a:b].tobytes()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("tie"), pa.array(ids, pa.binary())], names=["key", "tie", "ids"])
        blocks.tidy()

    source = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text), F.xxhash64(f"`{text}`").alias("tie"))
    return source.mapInArrow(run, "key long, tie long, ids binary")


def unpack(ids: pa.Array) -> list[np.ndarray]:
    pack = zstandard.ZstdDecompressor()
    return [np.frombuffer(pack.decompress(raw[1:]), f"<u{raw[0]}") for raw in ids.to_pylist()]


def count(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs; at most one row per id and task travels."""
    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            some = np.bincount(np.concatenate(unpack(batch.column("ids"))))
            total = np.pad(total, (0, max(0, len(some) - len(total))))
            total[:len(some)] += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    out = np.zeros(max((r.id for r in rows), default=0) + 1)
    for r in rows:
        out[r.id] = r.n
    return out


def _writer(folder: str, counts: np.ndarray):
    """Writes a partition's rows to files and returns their lines of the manifest."""
    def run(batches):
        table = Frequencies(counts)
        number, made, ids, held = TaskContext.get().partitionId(), 0, [], []

        def flush():
            name = f"part-{number:06d}-{made:04d}.rans"
            n = np.array([len(x) for x in held], np.int64)
            write_file(folder, name, table, np.array(ids, np.int64), n, np.concatenate(held).astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(n)]), pa.array([int(n.sum())])], names=["file", "docs", "tokens"])

        size = 0
        for batch in batches:
            for doc, tokens in zip(batch.column("key").to_pylist(), unpack(batch.column("ids"))):
                ids.append(NO_KEY if doc is None else doc)
                held.append(tokens)
                size += len(tokens)
                if size >= 2 * SPLIT:  # a file of bounded size, so that a task holds no more
                    yield flush()
                    made, ids, held, size = made + 1, [], [], 0
        if ids:
            yield flush()
        blocks.tidy()

    return run


def write(df: DataFrame, folder: str, model: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``text`` with the tokenizer at ``model``, put ``end`` after each row, and write files in order of ``key``.

    Returns the manifest (file, docs, tokens), also stored as ``folder``/manifest. Rows of equal keys
    are ordered by a hash of their text; a null key is written as the least integer and sorts first; null
    texts are empty. Other columns are not written.
    """
    spark = df.sparkSession
    with shared.scope(spark):
        encoded = shared.materialize(encode(df, model, end, key, text))
        counts = count(encoded)
        ordered = encoded.repartitionByRange(F.col("key").asc_nulls_first(), "tie").sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
        ordered.select("key", "ids").mapInArrow(_writer(folder, counts), "file string, docs long, tokens long").write.parquet(f"{folder}/manifest")
    store.put(folder, "frequencies.bin", [counts.astype("<i8").tobytes()])
    return spark.read.parquet(f"{folder}/manifest")


@lru_cache(4)
def frequencies(folder: str) -> Frequencies:
    fs, path = store.at(f"{folder}/frequencies.bin")
    with fs.open_input_stream(path) as f:
        return Frequencies(np.frombuffer(f.read(), "<i8"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids, crc) of every document in the files.

    ``start`` counts the ids of all documents before it; ``crc`` is the crc32 of its ids as little-endian uint32.
    """
    from pyspark.sql import Window

    files = spark.read.parquet(f"{folder}/manifest")  # one row per file
    before = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    shares = F.greatest(F.lit(1), F.ceil(F.col("tokens") / SPLIT - 0.25)).cast("int")  # a file of just over two shares makes no third
    n = files.agg(F.sum(shares)).first()[0] or 1  # as many tasks as shares
    tasks = (files.select("file", F.coalesce(before, F.lit(0)).alias("start"), shares.alias("parts"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(int(n), F.col("file"), F.col("part")))

    def run(batches):
        if tokenizer.cache_info().currsize:  # words that this worker kept for encoding
            tokenizer.cache_clear()
            blocks.tidy()
        table = frequencies(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, first, counts, tokens = read_file(folder, row["file"], table, row["part"], row["parts"])
                step = max(1, int(len(ids) * SENT / max(1, len(tokens))))
                upto = np.concatenate([[0], np.cumsum(counts)])
                for a in range(0, len(ids), step):
                    b = min(len(ids), a + step)
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(upto[a:b].tolist(), upto[a + 1:b + 1].tolist())]
                    null = ids[a:b] == NO_KEY
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a:b], mask=null), pa.array(first[a:b] + row["start"]),
                         blocks.lists(tokens[upto[a]:upto[b]].astype(np.int32), upto[a:b + 1] - upto[a], pa.int32()),
                         pa.array(crc, pa.int64())], names=["doc_id", "start", "ids", "crc"])
        blocks.tidy()

    return tasks.mapInArrow(run, "doc_id long, start long, ids array<int>, crc long")
