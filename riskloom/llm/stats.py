"""Counts over whole texts, for slices of a text column."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from riskloom.llm import blocks


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


SYMBOLS = _set("#*$%&|<>")
UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = UPPER | _set("abcdefghijklmnopqrstuvwxyz")
DIGITS = _set("0123456789")
MARKS = _set("!?;:.,'\"()[]{}-_/\\@=+~^`")
SENTENCE = _set(".!?")
BANG = _set("!")

#: Names of the counts, all long.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_upper", "n_letters", "n_digits", "n_marks",
         "n_sentence", "n_bang", "n_lines", "n_distinct", "n_bare", "longest_word")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _distinct(row: np.ndarray, code: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct codes in each row."""
    key = np.unique(row.astype(np.int64) << 32 | code)
    return np.bincount(key >> 32, minlength=n_rows)


def repeated(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True for each word in a window of three that its row holds twice or more."""
    out = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return out
    at = np.flatnonzero(row[:-2] == row[2:])
    # Only windows whose hash occurs twice are compared.
    h = row[at].astype(np.uint64)
    for k in range(3):
        h = blocks.mix(h * np.uint64(3) + codes[at + k].astype(np.uint64))
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return out
    at = at[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h]
    _, pair = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True)
    _, triple = np.unique(pair.astype(np.int64) << 32 | codes[at + 2], return_inverse=True)
    _, which, times = np.unique(row[at].astype(np.int64) << 32 | triple, return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    for k in range(3):
        out[twice + k] = True
    return out


class Words(NamedTuple):
    """The words `[^\\x20\\x09-\\x0D]+` of a column: codes, distinct values, offsets of rows and of lines, the row of each line."""

    codes: np.ndarray
    distinct: pa.Array
    rows: np.ndarray
    lines: np.ndarray
    line_rows: np.ndarray


def _of_distinct(codes: np.ndarray, distinct: pa.Array, at: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that are taken from the distinct words."""
    n = len(at) - 1
    out = {"n_distinct": _distinct(row, codes, n)}
    _, cuts, raw = distinct.buffers()
    cuts = np.frombuffer(cuts, np.int64)[:len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
    letters = np.concatenate([[0], np.cumsum((LETTERS | (np.arange(256) >= 128))[np.frombuffer(raw or b"", np.uint8)], dtype=np.int64)])
    bare = np.diff(letters[cuts]) == 0
    out["n_bare"] = _per_row(bare[codes], at)
    size = np.concatenate([np.diff(cuts)[codes], [0]])
    longest = np.maximum.reduceat(size, np.minimum(at[:-1], len(size) - 1)) if n else np.zeros(0, np.int64)
    out["longest_word"] = np.where(np.diff(at) > 0, longest, 0)
    return out


def counts(column: pa.Array, names: tuple[str, ...] = NAMES) -> tuple[dict[str, np.ndarray], Words]:
    """The counts of each row, those of ``names`` at least, and its words."""
    data, rows = blocks.buffers(column)
    n = len(rows) - 1
    flat, at, place = blocks.placed(column, blocks.BLANK_WORDS)
    codes, distinct = blocks.coded(flat)
    row = np.repeat(np.arange(n), np.diff(at))
    out = {"n_words": np.diff(at)}
    start = (data & 0xC0) != 0x80  # first bytes of code points
    out["word_chars"] = _per_row(start & blocks.BLANK_WORDS[data], rows)
    if "n_chars_all" in names:
        out["n_chars_all"] = _per_row(start, rows)
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_letters", LETTERS), ("n_digits", DIGITS), ("n_marks", MARKS),
                        ("n_sentence", SENTENCE), ("n_bang", BANG)):
        if name in names:
            out[name] = _per_row(table[data], rows)
    # Lines: pieces between \n and row edges.
    feed = data == 10
    line_row = np.repeat(np.arange(n), _per_row(feed, rows) + 1)
    begin = np.sort(np.concatenate([rows[:-1], np.flatnonzero(feed) + 1]), kind="stable")
    stop = np.sort(np.concatenate([rows[1:], np.flatnonzero(feed)]), kind="stable")
    wordy = np.concatenate([[0], np.cumsum(blocks.BLANK_WORDS[data], dtype=np.int64)])
    some = wordy[stop] > wordy[begin]
    kept = np.ones(len(data), bool)
    kept[feed] = False
    lines = blocks.strings(data[kept], np.concatenate([[0], np.cumsum(stop - begin)]))
    line_codes, _ = blocks.coded(lines)
    out["n_lines"] = np.bincount(line_row[some], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_row[some], line_codes[some], n)
    out["n_repeat_words"] = np.bincount(row[repeated(codes, row)], minlength=n)
    if {"n_distinct", "n_bare", "longest_word"} & set(names):
        out |= _of_distinct(codes, distinct, at, row)
    return out, Words(codes, distinct, at, np.append(np.searchsorted(place, begin), len(codes)), line_row)
