"""Main text: the reader, the decoder against all choices, held-out layouts, and the given pages against a plain version."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import dom, maintext, sitepages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return maintext.fit(spark, pages=400, trees=20)


def blocks_of(page):
    forest = dom.Forest()
    forest.add(page)
    return [t for t in forest.text if t is not None]


@pytest.mark.parametrize("page, want", [
    ("", []), ("  \n", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("a<b>b</b> c<br>d  &nbsp; e", ["ab c d e"]), ("<script>var t='</p>';</script>x<style>p{}</style>y", ["xy"]),
    ("<title>t</title><!-- <p>no --><p>1 < 2 <3</p><!-->z", ["1 < 2 <3", "z"]), ("<p title='a>b' class=x>in</p >out", ["in", "out"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>&amp;lt;&#65;&#x42;&unknown; &copy</p>", ["&lt;AB&unknown; ©"]), ("<select><option>no</select>yes<button>no</button>", ["yes"]),
    ("</div></p>x</span>y<script>never closed", ["xy"]), ("<button>open<p>kept", ["open", "kept"]), ("<a href=\"x", []), ("<h1>a</h2>b", ["a", "b"]),
    ("<!DOCTYPE html><?php x ?><![CDATA[ no ]]>z</>w</ x>", ["zw"]),
])
def test_reader(page, want):
    assert blocks_of(page) == want


def test_tree_is_nested(spark):
    rng = random.Random(5)
    tags = ["<p>", "</p>", "<div class='a b'>", "</div>", "<li>", "</li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<h1>", "</h3>", "<a>", "</a>", "x ", "<b>", "<section>", "</section>", "<br>"]
    for _ in range(300):
        forest = dom.Forest()
        for _ in range(2):
            forest.add("".join(rng.choice(tags) for _ in range(60)))
        for k, parent in enumerate(forest.parent):
            assert forest.end[k] > k and (parent < 0 or parent < k < forest.end[k] <= forest.end[parent])
            assert parent < 0 or forest.text[parent] is None
        assert np.isfinite(dom.features(forest, {"<p>": 1.0})).all()


def test_decoder_takes_the_best_choice_without_contradiction():
    rng = random.Random(3)
    for _ in range(200):
        forest = dom.Forest()
        forest.add("".join(rng.choice(["<div>", "<div>", "</div>", "x", "<p>y</p>"]) for _ in range(8)))
        n = len(forest.parent)
        odds = np.array([rng.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 3.0]) for _ in range(n)])

        def fits(choice):
            return all((forest.parent[k] < 0 or choice[forest.parent[k]]) and (forest.text[k] is not None or any(choice[j] for j in range(n) if forest.parent[j] == k))
                       for k in range(n) if choice[k])

        best = max(sum(o for o, c in zip(odds, choice) if c) for choice in itertools.product([False, True], repeat=n) if fits(choice))
        got = maintext.decode(forest, odds)
        assert fits(got) and abs(odds[got].sum() - best) < 1e-9


@pytest.mark.parametrize("layout, floor", [("semantic", 0.97), ("named", 0.97), ("mixed", 0.97), ("unnamed", 0.88), ("table", 0.88), ("bare", 0.94)])
def test_held_out_pages(model, layout, floor):
    forest, main = maintext.annotated(list(range(500_000, 500_120)), layout)
    got = maintext.decode(forest, maintext.margins(dom.features(forest, model[0]), model[1]))
    words = np.array([len(t.split()) if t else 0 for t in forest.text])
    both = words[main & got].sum()
    assert both / words[got].sum() > floor and both / words[main].sum() > floor


def plain(page):
    """The blocks of the given pages' article element."""
    parts = re.split("</?(?:h1|p)>", page[page.index("<article>") + 9:page.index("</article>")])
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_given_pages_equal_a_plain_version(spark):
    import __spark_entry__ as contract

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    made = contract.queries()["op11_maintext"](spark, SF).collect()
    assert len(made) == len(pages)
    for r in made:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_edge_rows(spark, model):
    page = "<nav><a href=x>menu</a></nav><article><h1>Title of it</h1><p>Some words, and some more words of the article.</p></article>"
    rows = [(1, None, "a"), (2, "", "b"), (3, page, "c"), (3, page, "c"), (None, "<div>", "d")]
    frame = spark.createDataFrame(rows, "page_id long, html string, main_text string").withColumns({"_row": F.lit(1), "_html": F.lit(2), "_text": F.lit(3)})
    made = maintext.extract(frame, model=model).collect()
    assert len(made) == 5 and all((r._row, r._html, r._text) == (1, 2, 3) for r in made)
    texts = sorted((r.html or "", r.main_text) for r in made)
    assert [t for _, t in texts[:3]] == ["", "", ""] and texts[3] == texts[4]
    assert "some more words" in texts[3][1] and "menu" not in texts[3][1]
    replaced = maintext.extract(frame, text="html", model=model, keep=["page_id"]).collect()
    assert sorted(r.html for r in replaced)[:3] == ["", "", ""]
    assert maintext.extract(frame.limit(0), model=model).count() == 0


@pytest.mark.parametrize("page", ["<p>" + "word and word, " * 350_000, "<div>" * 100_000 + "x" + "</p></div>" * 100_000, "<p>" + "x" * 5_000_000, "<a href='" * 200_000, "<button>" * 200_000 + "<!--" * 100_000,
                                  "<article>" + "<p>Some words of a paragraph here.</p>" * 100_000 + "</article>", "<li>" * 100_000, "&amp;" * 1_000_000])
def test_very_long_pages(model, page):
    begin = time.time()
    maintext.texts([page], model)
    assert time.time() - begin < 20
