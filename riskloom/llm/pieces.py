"""SentencePiece BPE encoding and decoding by a prefix table.

Every prefix of a text has exactly one last token in its encoding. An automaton over the vocabulary
lists the tokens that end at each character; the last token of the prefix is the one that fits the
last token of the shorter prefix it leaves, where two tokens fit if merging their joined text gives
just these two. Ids are then read off backwards. Time is linear in the text.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from riskloom.llm import blocks

SPACE = "▁"
#: Entries of a worker's caches, of which there are two generations; they only save time.
CACHED = 120_000
SLICE_BYTES = 2 << 20  # text encoded at once in a task

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceTable:
    """The vocabulary of a BPE model with byte fallback."""

    def __init__(self, path: str):
        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        if sp.encode("a  b", out_type=str) == sp.encode("a b", out_type=str) or not sp.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("only models that keep blanks and add a leading one are supported")
        self.eos = sp.eos_id()
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {pieces[i]: sp.get_score(i) for i in plain}
        self.id_of = {pieces[i]: i for i in plain}
        #: Words can be encoded one by one only if no piece goes from another character on to a blank.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        known = {c for p in self.id_of for c in p}
        self.spelled = {i: p for p, i in self.id_of.items()}
        for n, c in enumerate(sorted(known - self.id_of.keys())):  # characters that pieces hold but that are none
            self.spelled[len(pieces) + n] = c
        self.known = frozenset(known)
        self.virtual = len(pieces)
        self.sizes = {i: len(p) for i, p in self.spelled.items()}
        self.automaton = ahocorasick.Automaton()
        for i, p in self.spelled.items():
            if self.merged(p) == [p]:  # a piece that merging never reaches occurs in no encoding
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        surface = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        self.surface = pa.array(surface, pa.large_binary())
        self.control = np.array([sp.is_control(i) for i in ids])
        self.blank_first = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and p.startswith(SPACE) for i, p in enumerate(pieces)])

    def clear(self) -> None:
        """Forget words and pairs; they only save time."""
        self.fits, self.seen, self.older = {}, {}, {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals: the definition, for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        left, right = self.spelled[a], self.spelled[b]
        if len(self.fits) >= 2 * CACHED:
            self.fits.clear()
        self.fits[a << 32 | b] = ok = self.merged(left + right) == [left, right]
        return ok

    def _run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        last = [-1] * len(text)  # of the prefix that ends here
        sizes, fits, fit = self.sizes, self.fits, self.fit
        for end, i in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            at = end - sizes[i]
            if at < 0:
                last[end] = i
            elif (before := last[at]) >= 0:
                ok = fits.get(before << 32 | i)
                if fit(before, i) if ok is None else ok:
                    last[end] = i
        out, end = [], len(text) - 1
        while end >= 0:
            i = last[end]
            if i < self.virtual:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in reversed(self.spelled[i].encode()))
            end -= sizes[i]
        out.reverse()
        return out

    def ids(self, text: str) -> tuple[int, ...]:
        """Ids of a text in which blanks are already the model's own sign."""
        found = self.seen.get(text)
        if found is not None:
            return found
        if (found := self.older.get(text)) is not None:
            return self.note(text, found)
        if self.known.issuperset(text):
            out = self._run(text)
        else:
            out, run = [], []
            for c in text:
                if c in self.known:
                    run.append(c)
                    continue
                out += self._run("".join(run))
                run = []
                out += [self.byte_ids[b] for b in c.encode()]
            out += self._run("".join(run))
        return self.note(text, tuple(out))

    def note(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Remember a short text; what was not asked for since the last turn-over is forgotten at the next."""
        if len(text) <= 64:
            if len(self.seen) >= CACHED:
                self.seen, self.older = {}, self.seen
            self.seen[text] = ids
        return ids

    def encode(self, column: pa.Array, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows and the rows' offsets."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        column = pc.replace_substring(column, SPACE, " ")
        empty = pc.equal(pc.binary_length(column), 0)
        data, rows = blocks.buffers(pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))))
        at = rows[:-1][np.diff(rows) > 0]
        if self.splits:
            blank = data == 32
            first = blank.copy()
            first[1:] &= ~blank[:-1]
            first[at] = True
            at = np.flatnonzero(first)
        codes, distinct = blocks.coded(blocks.strings(data, np.append(at, len(data))))
        each = [self.ids(c.decode().replace(" ", SPACE)) for c in distinct.to_pylist()]
        ids, upto = blocks.spread(each, codes)
        offsets = upto[np.searchsorted(at, rows)]
        return blocks.ended(ids, offsets, self.eos) if end else (ids, offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of rows of ids: pieces joined, the leading blank dropped, bytes that are no UTF-8 replaced one by one."""
        taken = self.surface.take(pa.array(ids))
        cuts = np.frombuffer(taken.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)
        begin, stop = cuts[offsets[:-1]].copy(), cuts[offsets[1:]]
        some = np.flatnonzero(np.diff(offsets) > 0)
        lead = offsets[:-1][some]
        begin[some] += self.blank_first[ids[lead]]
        for r, k in zip(some[self.control[ids[lead]]], lead[self.control[ids[lead]]]):  # control ids come first: look behind them
            while k < offsets[r + 1] and self.control[ids[k]]:
                k += 1
            begin[r] += k < offsets[r + 1] and self.blank_first[ids[k]]
        raw = data.tobytes()
        return pa.array([raw[a:b].decode(errors="each_byte") for a, b in zip(begin.tolist(), stop.tolist())], pa.large_string())


@lru_cache(2)
def table(path: str) -> PieceTable:
    return PieceTable(path)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", end: bool = True,
           decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append the token ids of ``text`` (array<int>), with the end id last if ``end``.

    ``model`` is a path that every executor has. ``decoded`` names a further column with the text that
    the ids decode to. Null and empty texts have no ids but the end id. Columns of the same names are
    replaced; rows are independent of each other, so repeated rows and ties need no rule.
    """
    added = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if decoded:
        added = added.add(decoded, T.StringType())

    def run(column: pa.Array) -> list[pa.Array]:
        t = table(model)
        flat, offsets = t.encode(column, end)
        made = [blocks.lists(flat, offsets, pa.int32())]
        return [*made, t.decode(flat, offsets).cast(pa.string())] if decoded else made

    def after() -> None:
        table(model).clear()
        blocks.tidy()

    return blocks.map_text(df, text, added, run, keep, SLICE_BYTES, after)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text that ``ids`` decode to; null ids give an empty text."""
    schema = T.StructType([*(f for f in df.schema if f.name != text), T.StructField(text, T.StringType())])

    def run(batches):
        t = table(model)
        for batch in batches:
            rows = pc.fill_null(batch.column(ids).cast(pa.large_list(pa.int32())), [])
            offsets = np.asarray(rows.offsets, np.int64)
            flat = rows.values.to_numpy(zero_copy_only=False)
            made = t.decode(flat[offsets[0]:offsets[-1]], offsets - offsets[0]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema[:-1]), made], names=schema.names)

    return df.mapInArrow(run, schema)
