"""Operators that judge rows one by one, against libraries or plain Python."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import blocks, decontaminate, licences, pieces, rans, stats
from riskloom.sources import shared

from .conftest import EDGES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def noise(n, seed=1, alphabet="ab eth.,!0\n\té▁日\U0001F600#'sT<|>"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_equal_the_library(spark, docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = noise(2000) + [t or "" for t in EDGES]
    t = pieces.table(PIECES)
    ids, at = t.encode(pa.array(texts), False)
    want = sp.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert t.decode(ids, at).to_pylist() == sp.decode(want)
    rng = random.Random(3)
    rows = [[rng.randrange(400 if k % 2 else 32000) for _ in range(rng.randrange(6))] for k in range(1000)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert t.decode(np.array([i for r in rows for i in r], np.int32), at).to_pylist() == [sp.decode(r) for r in rows]

    got = pieces.encode(docs, PIECES, decoded="note").collect()
    assert all(r.ids == sp.encode(r.text or "") + [2] and r.note == sp.decode(r.ids) and r.band == 7 for r in got)
    again = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert all(r.decoded == sp.decode(r.ids) for r in again)
    assert pieces.encode(none, PIECES).count() == 0



def test_pieces_of_words_encode_like_whole_texts():
    """Signs that the tokenizer treats in their own ways, alone and in random company."""
    rng = random.Random(5)
    signs = "aAzZ09'#,.<|>_éÉßÿÀ×÷ñ\u0301\u00a0\u2003\u00aa\u00bd日ǅİŒ\x00\x7f "
    texts = ["", None, "don't STOP", "a<|endoftext|>b", "<|x", "x×y÷z", "12a3,4.", "ﬁ ½ ² ٣", "e\u0301é", "it's'd 's't", "5é5É", "É", "a<b|c <| |<",
             "<|startoftext|><|endoftext|>!!", "x" * 100_000, "É#" * 50_000, "日本語テスト1"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    ids, upto = rans.tokenizer(WORDS).encode(pa.array(texts, pa.string()), 1)
    want = Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for k, e in enumerate(want):
        assert ids[upto[k]:upto[k + 1]].tolist() == [*e.ids, 1], texts[k][:50]


def test_frequent_pieces_outlive_a_full_table(monkeypatch):
    """A piece of the table before is not given to the library again, and the ids stay those of the library."""
    monkeypatch.setattr(rans.Words, "CACHED", 3)
    t, asked = rans.Words(WORDS), []
    learn = t.learn
    monkeypatch.setattr(t, "learn", lambda new: (asked.extend(new), learn(new)))
    lib = Tokenizer.from_file(WORDS)
    for text in ("one two three four", "one two five", None, "six one two", "one's seven twö"):
        ids, upto = t.encode(pa.array([text, ""], pa.string()), 1)
        assert ids.tolist() == [*(lib.encode(text or "", add_special_tokens=False).ids), 1, 1] and upto[-1] == len(ids)
    assert len(asked) == len(set(asked)) and b"one" in asked


def test_ids_survive_the_files(spark, docs, none):
    lib = Tokenizer.from_file(WORDS)
    t = rans.tokenizer(WORDS)
    texts = noise(3000) + ["<|endoftext|>", "a<|endoftext|>b's"]
    ids, at = t.encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids + [1] for e in lib.encode_batch(texts, add_special_tokens=False)]

    more = docs.union(docs.where("doc_id = 4").selectExpr("null", "text", "lang", "source", "note", "band")).repartition(3)
    folder = shared.scratch(spark, "ids")
    rans.write(more, folder, WORDS, 1)
    got = sorted(rans.read(spark, folder).collect(), key=lambda r: r.start)
    rows = sorted(more.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for r, d in zip(got, rows):
        want = lib.encode(d.text or "", add_special_tokens=False).ids + [1]
        assert (r.ids, r.start, r.crc) == (want, start, zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    rans.write(none, empty := shared.scratch(spark, "ids"), WORDS, 1)
    assert rans.read(spark, empty).count() == 0


def test_blocks_of_a_file_decode_alone_and_tell_damage(tmp_path):
    rng = np.random.default_rng(1)
    tokens = np.minimum(rng.geometric(0.01, 200_000), 5000).astype(np.uint32)
    counts = np.bincount(np.arange(len(tokens)) // 777)
    table = rans.Frequencies(np.bincount(tokens))
    ids = np.arange(len(counts)) * 3
    rans.write_file(str(tmp_path), "a.rans", table, ids, counts, tokens)
    parts = [rans.read_file(str(tmp_path), "a.rans", table, k, 5) for k in range(5)]
    assert (np.concatenate([p[3] for p in parts]) == tokens).all() and (np.concatenate([p[0] for p in parts]) == ids).all()
    assert (tmp_path / "a.rans").stat().st_size < 1.2 * len(tokens)
    raw = bytearray((tmp_path / "a.rans").read_bytes())
    raw[-1000] ^= 1
    (tmp_path / "b.rans").write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        rans.read_file(str(tmp_path), "b.rans", table)
    assert rans.Frequencies(np.array([5, 0, 1])).f.sum() == 1 << 12
    assert list(rans.Frequencies(np.zeros(1)).encode(np.zeros(0, np.uint32))) == []


def brute_hits(text, items, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    w, hit, found = word.findall(low(text)), set(), set()
    for item, t in items:
        p = word.findall(low(t))
        m = min(size, len(p))
        for k in range(len(p) - m + 1 if p else 0):
            for a in range(len(w) - m + 1):
                if w[a:a + m] == p[k:k + m]:
                    hit |= set(range(a, a + m))
                    found.add(item)
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("share_bytes", [1 << 20, 40])
def test_hits_equal_brute_force(spark, docs, none, share_bytes):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abc") for _ in range(n))) for k, n in enumerate((4, 5, 9, 1, 2, 0))] + [(0, "A, b! c"), (9, None), (8, "Über-ß x")]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "über ß X", "aé b", "A.B.C"]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items + [(None, "d d d d")], "item_id long, text string")
    for r in decontaminate.find(frame, bench, size=4, share_bytes=share_bytes).collect():
        got = [p for h in r.hits for p in range(h.first, h.last + 1)]
        assert (r.n_words, got, r["items"]) == brute_hits(r.text, items, 4), r.text
    assert decontaminate.find(none, bench).count() == 0
    assert all(not r.hits for r in decontaminate.find(docs, bench.limit(0)).collect())


def test_counts_equal_plain_python():
    texts = noise(400, 2, "aB #\n\t$ é!1.") + [t or "" for t in EDGES] + ["a b c a b c\na b c\na b c"]
    made, _ = stats.counts(pa.array(texts))
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for p in range(len(w) - 2):
            at.setdefault(tuple(w[p:p + 3]), []).append(p)
        twice = {p + d for v in at.values() if len(v) > 1 for p in v for d in range(3)}
        want = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_dup_lines=len(lines) - len(set(lines)),
                    n_repeat_words=len(twice), n_lines=len(lines), n_distinct=len(set(w)), longest_word=max((len(x.encode()) for x in w), default=0))
        assert {c: int(made[c][k]) for c in want} == want, t


def test_long_hashes_tell_rows_apart():
    rows = [b"", b"a", b"\0", b"\0\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * 100, b"x" * 99]
    h = blocks.hash_words_long(np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, rows)))]))
    assert len(set(h.tolist())) == len(rows)


def test_hash_words_takes_words_of_megabytes():
    rng = np.random.default_rng(3)
    values = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (1, 8, 63, 64, 65, 66, 200, 5 << 20)]
    values += [values[-1][:-1] + b"!", b"!" + values[-1][1:], b"", values[4][:-1]]
    start = time.time()
    h = blocks.hash_words(pa.array(values * 2, pa.large_binary()))
    assert time.time() - start < 10 and (h[:len(values)] == h[len(values):]).all() and len(set(h.tolist())) == len(values)
    assert (blocks.hash_words(pa.array(values, pa.large_binary()).slice(3, 4)) == h[3:7]).all()


def test_training_windows_come_from_anywhere_in_a_line(spark):
    long = " ".join(f"w{k}" for k in range(1000))
    rows = [(k, f"\n .\n{long}\n!") for k in range(60)] + [(60, "Ä " + "Z" * 5000), (61, " \n."), (62, "")]
    got = {r.k: r.p.split(" ") for r in licences.windows_of(spark.createDataFrame(rows, "k long, t string")).collect()}
    assert got.keys() == set(range(61)) and [len(w) for w in got[60]] == [1, 64]
    firsts = [int(got[k][0][1:]) for k in range(60)]
    assert all(got[k] == [f"w{i}" for i in range(f, f + licences.WINDOW)] for k, f in enumerate(firsts)) and max(firsts) > 600 and min(firsts) < 300


def test_licence_notices_are_found_and_prose_is_not(spark, docs, none):
    rng = random.Random(7)
    words = [x + y for x in "nd the ou er st".split() for y in "a en ing ti or".split()]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 90))) for _ in range(120)]
    notice = {1: ("mit", "Released under the MIT License."), 2: ("gpl", "This work is licensed under the GNU General Public License, version 3."), 3: ("cc-by-nc", "Licensed under CC BY-NC 4.0.")}
    rows = [(k, p + "\n" + notice[k % 4][1] + "\n" + p if k % 4 else p, "x") for k, p in enumerate(prose)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    model = licences.train(frame, "doc_id", "text")
    for r in licences.scan(frame, model=model).collect():
        sure = [(x.family, x.paragraph) for x in r.licences if x.confirmed]
        assert sure == ([(notice[r.doc_id % 4][0], 1)] if r.doc_id % 4 else []), r
    talk = spark.createDataFrame([(1, "All rights reserved by the publisher under a commercial license agreement."), (2, None)], "doc_id long, text string")
    assert [[x.confirmed for x in r.licences] for r in licences.scan(talk, model=model).orderBy("doc_id").collect()] in ([[False], []], [[], []])
    assert all(not any(x.confirmed for x in r.licences) and r.note == "kept as it is" for r in licences.scan(docs, model=model).collect())
    assert licences.scan(none, model=model).count() == 0


WRAPPED = {
    "gpl": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
            "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal",
            "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"],
    "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"],
}


def test_wrapped_notices_are_found_where_they_begin(spark):
    rng = random.Random(8)
    words = [x + y for x in "nd the ou er st".split() for y in "a en ing ti or".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for family, lines in WRAPPED.items():
        for sign in ("", "# ", "// ", " * "):
            for before in ([], [prose(12)], [prose(9), "", "Copyright (c) 2020 A. Writer"]):
                want[len(rows)] = (family, len(before))
                rows.append("\n".join(sign + x for x in [*before, *lines, "", prose(20)]))
    rows += [prose(9) + "\n" + prose(30) + "\n" + prose(7), "Released under the MIT License.\nReleased under the MIT License."]
    want[len(rows) - 2], want[len(rows) - 1] = None, "both"
    plain = spark.createDataFrame([(k, prose(rng.randrange(5, 90))) for k in range(120)], "doc_id long, text string")
    model = licences.train(plain, "doc_id", "text")
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in licences.scan(frame, model=model).collect():
        sure = [(x.family, x.paragraph) for x in r.licences if x.confirmed]
        one = want[r.doc_id]
        assert sure == ([] if one is None else [("mit", 0), ("mit", 1)] if one == "both" else [one]), (r, one)
