"""Fill-in-the-middle against a plain Python version."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from riskloom.llm import infill


def brute(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.transform(frame).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=str) == sorted(((k, *brute(k, t)) for k, t in rows), key=str)
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in rows)
    return {r.form for r in made}


def test_outputs_equal_brute_force(spark):
    rng = random.Random(12)
    alphabet = ["a", "Zz", " ", "\n", "$1", "\\", "é", "日", "😀", "<", "P>", "<S", ">", "<P", "M>", "\r\n", "\x00", "{", "}+"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for k in range(600)]
    rows += [(k, t) for k in (None, 1, 1, -5) for t in (None, "", "x", "plain <M> text", "two words", "two words")]
    assert check(spark, rows) == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    rows = [(k, t) for k in (2, 3, 4) for t in ("ab, " * 1_250_000, "x" * 5_000_000, "ß" * 2_500_000)]
    check(spark, rows)


def test_clashing_names_and_empty_tables(spark, docs, none):
    odd = docs.withColumns({"n": F.lit("x"), "output": F.lit("y"), "_text": F.lit("z"), "_key": F.lit(1), "_row": F.lit(2), "_x": F.lit(3)})
    made = infill.transform(odd).collect()
    assert len(made) == 22 and {(r._text, r._key, r._row, r._x, r.note) for r in made} == {("z", 1, 2, 3, "kept as it is")}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text) for r in made)
    assert infill.transform(none).count() == 0
