"""Learnt operators on the given tables: rows that took no part in the fit, and plain Python beside compiled rules."""

import math
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries, rules

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    made = queries.op2_rules(spark, SF).collect()
    assert len(made) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in made)
    known = [(r.score, labels[r.doc_id], r.predicted) for r in made if r.held_out and labels.get(r.doc_id) in (0, 1)]
    good, bad = [s for s, label, _ in known if label], [s for s, label, _ in known if not label]
    assert len(good) > 30 and len(bad) > 5
    assert sum(p == label for _, label, p in known) >= 0.95 * len(known)
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_labels_and_other_columns_change_no_score(spark, tmp_path):
    labels, docs = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/documents.parquet")
    flipped = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", flipped.cast("long")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumns({"lang": F.lit("xx"), "source": F.lit("other")}).write.parquet(f"{tmp_path}/documents.parquet")
    scores = [{r.doc_id: r.score for r in queries.op2_rules(spark, path).collect()} for path in (SMALL, str(tmp_path))]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 1


def test_compiled_rules_equal_plain_ones(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    measured = rules.measure(spark.read.parquet(f"{SMALL}/documents.parquet"), "text", ["doc_id", "text"])
    intercept, found = rules.fit(measured.join(labels, "doc_id"), "quality")
    assert found
    for r in measured.select("_s", rules.compile_score(intercept, found).alias("score")).collect():
        holds = lambda rule: all((r._s[n] <= t) == low for n, low, t in rule)
        want = 1 / (1 + math.exp(-intercept - sum(w for rule, w in found if holds(rule))))
        assert r.score == pytest.approx(want, abs=1e-12)


NOTICES = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
           "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}


def test_licences_of_all_documents(spark):
    """Every document that holds a notice's line is found under its family, and no other is."""
    made = {r.doc_id: r for r in queries.op3_licences(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert made.keys() == docs.keys()
    want = {k: ",".join(sorted(f for f, line in NOTICES.items() if line in t)) for k, t in docs.items()}
    assert sum(map(bool, want.values())) > 20
    assert {k: r.families for k, r in made.items()} == want
    for k, r in made.items():
        lines = docs[k].split("\n")
        assert all(re.search("licen", lines[int(p)], re.I) for p in r.paragraphs.split(",") if p)
        assert r.n_confirmed >= bool(want[k])
