"""Licence families of paragraphs.

A multinomial logistic regression over hashed word 1- and 2-grams is fitted on notices of each family (whole,
cut, thinned, between words of the corpus), on licence talk of no family, and on paragraphs of the corpus. A family
is predicted where its probability passes a threshold calibrated on rows that were not fitted; paragraphs that
look licensed but pass none are "unknown". A prediction is confirmed if the paragraph holds enough
of the word triples of one of the family's notices.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import blocks

FEATURES = 1 << 14
WINDOW, STEP = 40, 20  # words; longer paragraphs are judged in overlapping windows
SAMPLE = 1500  # documents that give paragraphs of no licence: those whose id has the least hash
VARIANTS = 40  # training texts made of each notice
LONG = 100  # characters beyond which a word of a training window is named by its SHA-256
CONFIRMED = 0.6  # share of a notice's triples
NONE, UNKNOWN = "none", "unknown"
UPPER, WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Usual notices of public licences.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "This work is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Released under the BSD 3-Clause License.", "Licensed under the BSD License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
            "Released under the MIT License.", "Licensed under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    UNKNOWN: ["All rights reserved by the publisher under a commercial license agreement.", "Use of this work is subject to the terms of our own license.",
              "Licensed for private use only, see the license terms of the vendor.", "Released under the house license of the institute."],
}
CLASSES = [NONE, *NOTICES]
RESULT = T.StructType([T.StructField("licences", T.ArrayType(T.StructType([
    T.StructField("family", T.StringType()), T.StructField("paragraph", T.IntegerType()), T.StructField("probability", T.DoubleType()),
    T.StructField("share", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])))])


def split(text: str) -> list[bytes]:
    return blocks.words(pa.array([text]), blocks.PLAIN_WORDS, lower=True)[0].to_pylist()


def hashed(words: pa.Array) -> np.ndarray:
    return blocks.hash_words(words) if len(words) else np.zeros(0, np.uint64)


def features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word, and of each word with the next."""
    one = (h % np.uint64(FEATURES)).astype(np.int64)
    two = (blocks.mix(h[:-1] * np.uint64(3) ^ h[1:]) % np.uint64(FEATURES)).astype(np.int64) if len(h) > 1 else np.zeros(0, np.int64)
    return one, two


def vector(words: list[bytes]):
    one, two = features(hashed(pa.array(words, pa.large_binary())))
    f = np.concatenate([one, two])
    at, n = np.unique(f, return_counts=True)
    return Vectors.sparse(FEATURES, at.tolist(), (n / np.sqrt(max(1, len(f)))).tolist())


def triples(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[k:k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


TEMPLATES = {f: [triples(split(n)) for n in notices] for f, notices in NOTICES.items() if f != UNKNOWN}


def share(family: str, words: list[bytes]) -> float:
    """The greatest part of a notice of the family whose word triples the words hold."""
    held = triples(words)
    return max((len(t & held) / len(t) for t in TEMPLATES.get(family, ())), default=0.0)


def extent(family: str, words: list[bytes]) -> tuple[int, int]:
    """The words from the first to the last triple of the family's best notice; all words if none is there."""
    held = triples(words)
    best = max(TEMPLATES.get(family, ()), key=lambda t: len(t & held) / len(t), default=set())
    at = [k for k in range(max(1, len(words) - 2)) if tuple(words[k:k + 3]) in best]
    return (at[0], min(at[-1] + 3, len(words))) if at else (0, len(words))


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, least: np.ndarray):
        self.weights, self.bias, self.least = weights, bias, least

    def probabilities(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def stretch(words: list[bytes], n: int, rng: random.Random) -> list[bytes]:
    """``n`` words one after another from a random place."""
    at = rng.randint(0, max(0, len(words) - n))
    return words[at:at + n]


def examples(corpus: list[str], seed: int = 5) -> list[tuple[int, list[bytes]]]:
    """Labelled word lists: windows of paragraphs of the corpus without a licence, and variants of all notices."""
    rng = random.Random(seed)
    plain = [w for w in (stretch(split(p), WINDOW, rng) for p in corpus) if w and max(share(f, w) for f in TEMPLATES) < 0.3]
    out = [(0, w) for w in plain]
    some = plain or [[b"text"]]
    for c, (family, notices) in enumerate(NOTICES.items(), 1):
        for notice in notices:
            words = split(notice)
            for v in range(VARIANTS):
                part = list(words)
                if v:
                    n = rng.randint(max(3, 2 * len(part) // 3), len(part)) if len(part) > 12 else len(part)
                    at = rng.randint(0, len(part) - n)
                    part = [w for w in part[at:at + n] if len(words) < 8 or rng.random() > 0.08]
                    before, after = rng.choice(some), rng.choice(some)
                    part = stretch(before, rng.choice((0, 0, 4, 12)), rng) + part + stretch(after, rng.choice((0, 0, 4, 12)), rng)
                out.append((c, part))
    return out


def windows_of(rows: DataFrame) -> DataFrame:
    """(k, p) of rows (k, t): WINDOW words of a line with words, both drawn by hashes of k; a very long word goes by its SHA-256."""
    lines = rows.select("k", F.filter(F.split(F.translate("t", UPPER, UPPER.lower()), "\n"), lambda x: x.rlike(WORD)).alias("t")).where(F.size("t") > 0)
    words = lines.select("k", F.regexp_extract_all(F.get("t", F.pmod(F.xxhash64("k"), F.size("t")).cast("int")), F.lit(f"({WORD})"), 1).alias("w"))
    begin = F.pmod(F.xxhash64("k", F.lit(1)), F.greatest(F.lit(1), F.size("w") - WINDOW + 1)).cast("int") + 1
    named = F.transform(F.slice("w", begin, WINDOW), lambda x: F.when(F.length(x) > LONG, F.sha2(x, 256)).otherwise(x))
    return words.select("k", F.array_join(named, " ").alias("p"))


def train(docs: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Model:
    """Fit on three quarters of the examples and set thresholds on the rest. ``sample`` bounds the corpus rows used."""
    chosen = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    one = windows_of(chosen)
    corpus = [r.p for r in blocks.lowest(one, "k", sample, docs.select(f"`{key}`").count()).collect()]  # ``sample`` rows of WINDOW words
    rows = examples(corpus)
    fit, held = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    frame = docs.sparkSession.createDataFrame([(float(c), vector(w)) for c, w in fit], ["label", "features"])
    lr = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial", standardization=False).fit(frame.coalesce(2))
    weights, bias = lr.coefficientMatrix.toArray().T.astype(np.float32), lr.interceptVector.toArray()
    if weights.shape[1] < len(CLASSES):  # no corpus rows and so no row of the last classes
        weights = np.pad(weights, ((0, 0), (0, len(CLASSES) - weights.shape[1])))
        bias = np.pad(bias, (0, len(CLASSES) - len(bias)), constant_values=-50.0)
    model = Model(weights, bias, np.full(len(CLASSES), 0.5))
    if held:
        total = np.array([weights[np.concatenate(features(hashed(pa.array(w, pa.large_binary()))))].sum(0, dtype=np.float64) for _, w in held])
        p = model.probabilities(total, np.array([2 * len(w) - 1 for _, w in held]))
        label = np.array([c for c, _ in held])
        for c in range(1, len(CLASSES)):  # above what any other row gets, but no more than most of its own get
            wrong, own = p[label != c, c], p[label == c, c]
            model.least[c] = min(max(0.3, float(wrong.max()) if len(wrong) else 0.3), float(np.quantile(own, 0.2)) if len(own) else 0.9)
    return model


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append ``licences`` (family, paragraph number, probability, share, confirmed) in order of paragraphs.

    Paragraphs are numbered by lines; each line has at most one entry for a family, that of its best window. Lines with words one
    after another are also read as one text, so a notice that is wrapped has one entry, at the line where it begins. ``family`` is "unknown" for licence
    talk that fits none. Null, empty and wordless texts have no entries; rows are judged alone, so repeated
    rows agree. A column named licences is replaced.
    """
    model = model or train(docs, key, text)

    def run(column: pa.Array) -> list[pa.Array]:
        out: list[list] = []
        step = 256
        for a in range(0, len(column), step):
            out += judge(column.slice(a, step), model)
        return [pa.array(out, pa.list_(pa.struct([("family", pa.string()), ("paragraph", pa.int32()), ("probability", pa.float64()), ("share", pa.float64()), ("confirmed", pa.bool_())])))]

    return blocks.map_text(docs, text, RESULT, run, keep)


def windows(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of stretches of words: number of the stretch, first word, end."""
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STEP) + 1), 0)
    of = np.repeat(np.arange(len(first)), count)
    x = first[of] + (np.arange(len(of)) - (np.cumsum(count) - count)[of]) * STEP
    return of, x, np.minimum(x + WINDOW, first[of] + n[of])


def judge(column: pa.Array, model: Model) -> list[list[dict]]:
    data, rows = blocks.buffers(column)
    flat, at, place = blocks.placed(column, blocks.PLAIN_WORDS, lower=True)
    out: list[list] = [[] for _ in range(len(column))]
    if not len(flat):
        return out
    codes, distinct = blocks.coded(flat)
    h = hashed(distinct)[codes]
    one, two = features(h)
    feed = np.flatnonzero(data == 10) + 1
    begin = np.sort(np.concatenate([rows[:-1], feed]), kind="stable")
    first = np.searchsorted(place, begin)
    n = np.diff(np.append(first, len(codes)))
    per_row = np.diff(np.searchsorted(feed - 1, rows)) + 1
    of = np.repeat(np.arange(len(column)), per_row)
    paragraph = np.arange(len(begin)) - (np.cumsum(per_row) - per_row)[of]
    line, x, y = windows(first, n)
    # Wrapped text: lines with words one after another. Windows run over its line ends, from each line and every STEP words.
    wordy = n > 0
    opens = wordy & np.append(True, ~wordy[:-1] | (of[1:] != of[:-1]))
    head = np.flatnonzero(opens)
    block = np.cumsum(opens) - 1  # of each line with words
    size = np.bincount(block[wordy], n[wordy], len(head)).astype(np.int64)
    wrapped = np.bincount(block[wordy], minlength=len(head)) > 1
    _, bx, by = windows(first[head[wrapped]], size[wrapped])
    inner = np.flatnonzero(wordy & wrapped[np.maximum(block, 0)])
    bx = np.concatenate([bx, first[inner]])
    by = np.concatenate([by, np.minimum(first[inner] + WINDOW, (first[head] + size)[block[inner]])])
    n_line = len(x)
    x, y = np.concatenate([x, bx]), np.concatenate([y, by])
    zero = np.zeros((1, len(CLASSES)))
    upto = np.concatenate([zero, np.cumsum(model.weights[one], 0, dtype=np.float64)])
    total = upto[y] - upto[x]
    upto = np.concatenate([zero, np.cumsum(model.weights[two], 0, dtype=np.float64)]) if len(two) else zero
    total += upto[np.maximum(x, y - 1)] - upto[x]
    p = model.probabilities(total, 2 * (y - x) - 1)
    best = p[:, 1:].argmax(1) + 1
    look = np.flatnonzero(p[:, 0] < 0.5)
    seen: dict[tuple[int, str], dict] = {}
    over: list[tuple] = []  # windows over line ends: entry, lines
    for k in look.tolist():
        c = int(best[k])
        words = flat.slice(int(x[k]), int(y[k] - x[k])).to_pylist()
        family = CLASSES[c] if p[k, c] >= model.least[c] else UNKNOWN
        part = share(family, words)
        entry = {"family": family, "probability": round(float(p[k, c]), 6), "share": round(part, 6), "confirmed": part >= CONFIRMED}
        if k >= n_line:
            a, b = extent(family, words)
            lines = np.searchsorted(first, (x[k] + a, x[k] + b - 1), side="right") - 1
            over.append((entry, int(lines[0]), int(lines[1])))
            continue
        old = seen.get((int(line[k]), family))
        if old is None or (entry["share"], entry["probability"]) > (old["share"], old["probability"]):
            seen[int(line[k]), family] = entry
    found: dict[int, list] = {}
    for (k, _), entry in sorted(seen.items()):
        found.setdefault(k, []).append(entry)
    # The best windows first. What a confirmed one holds of its notice is no entry of its own line by line; one that is
    # not confirmed counts only where nothing else was found.
    made: list[tuple[int, dict]] = []
    spans: dict[str, set[int]] = {}
    for entry, a, b in sorted(over, key=lambda o: (not o[0]["confirmed"], -o[0]["share"], -o[0]["probability"], o[1])):
        family, held = entry["family"], range(a, b + 1)
        if entry["confirmed"]:
            if any(e["family"] == family and e["confirmed"] for k in held for e in found.get(k, ())) or spans.get(family, set()) & set(held):
                continue
            for k in held:
                if k in found:
                    found[k] = [e for e in found[k] if e["confirmed"]]
            spans.setdefault(family, set()).update(held)
        elif any(found.get(k) for k in held) or any(s & set(held) for s in spans.values()):
            continue
        else:
            spans.setdefault(family, set()).update(held)
        made.append((a, entry))
    for k, entry in made:
        found.setdefault(k, []).append(entry)
    for k in sorted(found):
        for entry in sorted(found[k], key=lambda e: e["family"]):
            out[int(of[k])].append({"family": entry["family"], "paragraph": int(paragraph[k]), **entry})
    return out
