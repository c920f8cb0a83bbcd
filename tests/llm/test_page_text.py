"""Main text of pages: the tree, the decoding against brute force, held-out layouts, and pages of known text."""
import itertools

import numpy as np
import pytest

from siliscope.llm import page_text as pt
from siliscope.llm.page_dom import FEATURES, KINDS, attribute_groups, features, parse

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return pt.fit(spark)


def runs(markup):
    page = parse(markup)
    return [(KINDS[page.kind[page.parent[i]]], page.text[i]) for i in range(len(page.parent)) if page.kind[i] == 1]


def test_tree_of_odd_markup():
    assert runs("") == [] and runs("  \n ") == []
    assert runs("a <b>b</b>\n\tc&nbsp;&amp;&eacute;&#233; d") == [("page", "a b c &éé d")]
    assert runs("<p>a<p>b<br>c<div>d</p>e") == [("paragraph", "a"), ("paragraph", "b c"), ("box", "d"), ("box", "e")]
    assert runs('<p><b>t<br><p>x</p>') == [("paragraph", "t"), ("paragraph", "x")]
    assert runs('<script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> -->yes<!-- open') == [("page", "yes")]
    assert runs('<title>no</title><textarea>no</textarea><SCRIPT>never ended') == []
    assert runs('<ul><li>a<li>b<ul><li>c</ul><li>d</ul>') == [("item", "a"), ("item", "b"), ("item", "c"), ("item", "d")]
    assert runs('<table><tr><td>a<td>b<tr><td>c</table>d') == [("cell", "a"), ("cell", "b"), ("cell", "c"), ("page", "d")]
    assert runs('<a href="x>y">l</a>k<img alt=">"><a title=\'q') == [("page", "lk")]
    assert runs("1 < 2 and <3 & 4 &am") == [("page", "1 < 2 and <3 & 4 &am")]
    page = parse('<div class="siteFooter x-ad"><a href=1>one</a> two</div>')
    assert page.link_chars[2] == 3 and page.outer[2] == attribute_groups(' class="footer ad"')
    assert parse("<div>" * 3000 + "deep").depth[-1] == 3001
    assert features([parse("<p>a</p>"), parse("")]).shape == (4, len(FEATURES))


def test_subtree_sums_and_siblings():
    page = parse("<div><p>aa bb</p><p>c</p></div><p>dddd</p>")
    rows = dict(zip(FEATURES, features([parse("x"), page])[2:].T))  # the first page's two nodes come first
    assert np.expm1(rows["log_chars"]).round(6).tolist() == [10, 6, 5, 5, 1, 1, 4, 4]
    assert rows["runs"].tolist() == [3, 2, 1, 1, 1, 1, 1, 1]
    assert rows["siblings"].tolist() == [1, 2, 2, 1, 2, 1, 2, 1] and rows["place"].tolist() == [0, 0, 0, 0, 1, 0, 1, 0]
    assert rows["starts_at"].tolist() == [0, 0, 0, 0, 0.5, 0.5, 0.6, 0.6]


def test_decoding_equals_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(120):
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        # preorder numbers: sort nodes by path
        children = {i: [j for j in range(n) if parent[j] == i] for i in range(n)}
        order, stack = [], [0]
        while stack:
            at = stack.pop()
            order.append(at)
            stack += reversed(children[at])
        number = {at: i for i, at in enumerate(order)}
        parent = [-1] + [number[parent[at]] for at in order[1:]]
        leaf = [i not in parent for i in range(n)]
        is_run = [leaf[i] and bool(rng.integers(0, 4)) for i in range(n)]
        scores = rng.normal(size=n)

        def fine(keep):
            return all(not keep[i] or (i == 0 or keep[parent[i]]) and (is_run[i] or any(keep[j] for j in range(n) if parent[j] == i)) for i in range(n))

        best = max(sum(scores[i] for i in range(1, n) if keep[i]) for keep in itertools.product((False, True), repeat=n) if fine(keep))
        kept = pt.kept_nodes(parent, is_run, scores)
        assert fine(kept) and abs(sum(scores[i] for i in range(1, n) if kept[i]) - best) < 1e-9


def test_trees_score_as_spark_does(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    nodes = pt.training_nodes(spark, layouts=20).select("features", "label")
    table = nodes.select(array_to_vector("features").alias("features"), "label")
    boosted = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(table)
    own = pt.read_trees(boosted.toDebugString)
    rows = boosted.transform(table).select(vector_to_array("features").alias("x"), vector_to_array("rawPrediction").alias("raw")).collect()
    got = own.log_odds(np.array([r.x for r in rows]))
    assert np.abs(got - 2 * np.array([r.raw[1] for r in rows])).max() < 1e-9


def test_held_out_layouts(model):
    wrong = total = whole = 0
    for seed in range(50_000, 50_200):
        page = parse(pt.layout(seed))
        truth = pt.marked_labels(page)
        kept = pt.kept_nodes(page.parent, [k == 1 for k in page.kind], model.log_odds(features([page])))
        errors = sum(page.kind[i] == 1 and bool(truth[i]) != kept[i] for i in range(len(kept)))
        wrong, total, whole = wrong + errors, total + sum(k == 1 for k in page.kind), whole + (errors == 0)
    assert wrong <= 0.02 * total and whole >= 150


ARTICLE = """<h1>Ring defects &amp; edges</h1><p>The wafer shows a ring near the edge, and
 a <a href="/s">scratch</a> across two chips.</p><p>Severity falls towards the centre; nine chips fail in all four lots.</p>"""
TEXT = ("Ring defects & edges\nThe wafer shows a ring near the edge, and a scratch across two chips.\n"
        "Severity falls towards the centre; nine chips fail in all four lots.")
PARTS = {
    "header": '<header><a href="/">Lab news</a><p>All about wafers.</p></header>',
    "menu": '<div class="main-menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">Archive</a></li></ul></div>',
    "notice": '<div id="cookie-banner"><p>We use cookies, as you may know, to make this site work.</p><button>Accept</button></div>',
    "sidebar": '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Edge faces explained</a></li></ul></aside>',
    "advert": '<div class="advertisement">Buy better probes today, with fifty percent off everything.</div>',
    "form": '<form><label>Search</label><input name="q"><button>Go</button></form>',
    "comments": '<section class="comments"><div class="comment"><p>I have seen that ring, too, on a lot of last week. Very odd.</p></div></section>',
    "footer": '<footer>&copy; 2020 Lab news &middot; imprint</footer>',
}


@pytest.mark.parametrize("shell", ["<article>{}</article>", '<div class="post-content">{}</div>', '<main><div class="row">{}</div></main>'])
def test_pages_of_known_text(spark, model, shell):
    rows = [(i, name, "<!DOCTYPE html><html><head><title>t</title></head><body>"
             + (part + shell.format(ARTICLE) if before else shell.format(ARTICLE) + part) + "</body></html>")
            for i, (name, part, before) in enumerate([(n, p, b) for n, p in PARTS.items() for b in (True, False)])]
    rows.append((100, "all", "<body>" + PARTS["header"] + PARTS["menu"] + PARTS["notice"] + shell.format(ARTICLE + PARTS["advert"]) + PARTS["sidebar"]
                 + PARTS["comments"] + PARTS["form"] + PARTS["footer"]))
    got = pt.extract(spark.createDataFrame(rows, PAGE), model).collect()
    assert {r.url: r.text for r in got if r.text != TEXT} == {}


def test_odd_rows_and_columns(spark, model):
    rows = [(1, None, None, "old", 1), (2, "u", "", "old", 2), (3, "u", f"<article>{ARTICLE}</article>", None, 3),
            (3, "u", f"<article>{ARTICLE}</article>", None, 3), (None, "v", "<nav><a href=1>x</a></nav>", "", 4),
            (5, "w", "<article><p>" + "word, " * 400_000 + "end.</p></article>", "", 5)]
    table = spark.createDataFrame(rows, PAGE + ", text string, `a.b` int")
    got = pt.extract(table, model)
    assert got.columns == ["page_id", "url", "html", "a.b", "text"]
    by_id = {r["a.b"]: r.text for r in got.collect()}
    assert by_id == {1: "", 2: "", 3: TEXT, 4: "", 5: ("word, " * 400_000 + "end.")}
    assert pt.extract(table.limit(0), model).count() == 0
