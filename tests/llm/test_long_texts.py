"""Texts of 5 MB and a word of 1 MB through whole queries."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The folder of the tables and the texts by id: 1 and 2 are equal and long, 3 is one word, 4 is short, 5 null."""
    path, rng = str(tmp_path_factory.mktemp("long")), random.Random(3)
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) > 12)
    names = [x + y + z for x in "ka lo mi nu re".split() for y in "ba de fi go hu".split() for z in "n s t r".split()]
    lines = [" ".join(rng.choice(names) for _ in range(12)) for _ in range(90_000)]
    long = "\n".join([*lines, "Released under the MIT License.", item])
    assert len(long) > 5_000_000
    texts = {1: long, 2: long, 3: "xY" * 500_000, 4: " ".join(lines[0].split()[:4]), 5: None}
    spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path, texts


def rows(spark, tables, name):
    made = {r.doc_id: r for r in getattr(queries, name)(spark, tables[0]).collect()}
    assert made.keys() == tables[1].keys()
    return made


def test_op2(spark, tables):
    made = rows(spark, tables, "op2_rules")
    assert made[1].score == made[2].score and all(0 <= r.score <= 1 for r in made.values())


def test_op5(spark, tables):
    made = rows(spark, tables, "op5_wu_manber")
    assert [made[k].contaminated for k in (1, 2, 3, 4, 5)] == [True, True, False, False, False] and made[1].n_hit == made[2].n_hit >= 10


def test_op7(spark, tables):
    made, lib = rows(spark, tables, "op7_rans"), Tokenizer.from_file(queries.WORDS)
    for k in (1, 4, 5):
        ids = [*lib.encode(tables[1][k] or "", add_special_tokens=False).ids, 1]
        assert (made[k].n_tokens, made[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_op8(spark, tables):
    made, lib = rows(spark, tables, "op8_pieces"), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for k in (1, 4, 5):
        ids = [*lib.encode(tables[1][k] or ""), 2]
        assert (made[k].n_tokens, made[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
