"""The pipeline's stages, each on its own input, against brute force."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from .test_corpus_operators import brute_cut, brute_groups
from .test_text_operators import brute_hits

SMALL = "/root/testdata/sf0.001"


def test_each_stage_does_its_work_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"hits": F.lit("x"), "kept": F.lit(1), "_rows": F.lit(2), "score": F.lit(3)})
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    columns = docs.columns
    for name, fn in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.shared.materialize(fn(spark, docs, SMALL))
        after = {r.doc_id: r for r in docs.collect()}
        assert name == "encoded" or docs.columns == columns
        assert after.keys() <= before.keys() and all(r.hits == "x" and r.kept == 1 and r["_rows"] == 2 for r in after.values())
        if name == "quality":
            assert not [k for k in after if labels.get(k) == 0] and not [k for k in before if k not in after and labels.get(k) == 1]
        if name == "near_duplicates":
            assert set(after) == {i for i, _, c in brute_groups([(r.doc_id, r.text) for r in before.values()]) if i == c}
        if name == "passages":
            want = {i: b.decode(errors="ignore") for i, b, _ in brute_cut([(r.doc_id, r.text.encode()) for r in before.values()])}
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        if name == "benchmark_free":
            flat = " ".join(re.sub("[^a-z0-9]+", " ", t.lower()) for _, t in items)
            suspects = {i for i, r in before.items() if i not in after or any(w in flat for w in r.text.lower().split("\n"))}
            assert {i for i in suspects if brute_hits(before[i].text, items, 10)[1]} == before.keys() - after.keys()
        if name == "encoded":
            assert after.keys() == before.keys() and all(r.decoded == r.text.replace("▁", " ") for r in after.values())


def test_edge_rows_pass(spark, docs):
    docs = docs.drop("note", "band").withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for name, fn in corpus_pipeline.STAGES:
        odd = corpus_pipeline.shared.materialize(fn(spark, odd, SMALL))
        if name == "near_duplicates":
            assert odd.where("doc_id IS NULL").count() <= 2 and odd.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").count() == 0
    empty = docs.limit(0)
    for _, fn in corpus_pipeline.STAGES:
        empty = corpus_pipeline.shared.materialize(fn(spark, empty, SMALL))
    assert empty.count() == 0


def test_of_repeated_ids_the_least_row_stays(spark):
    rows = [(1, t, "en", s, len(t)) for t, s in [("b" * 60, "x"), ("a b c d e f g", "y"), ("a b c d e f g", "x"), ("c", None)]] + [(2, "alone", "en", "z", 5)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = corpus_pipeline.shared.materialize(corpus_pipeline.near_duplicates(spark, docs, SMALL)).collect()
        assert sorted((r.doc_id, r.text, r.source) for r in got) == [(1, "a b c d e f g", "x"), (2, "alone", "z")]
