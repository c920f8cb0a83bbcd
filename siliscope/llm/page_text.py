"""Main text of web pages by gradient-boosted trees over the nodes of their block tree.

Every node, a block or a run of text, is judged by its own and its subtree's measures (``page_dom.FEATURES``): text per run and
per node, link share, words of its class and id, roles of itself and its ancestors, depth, place and likeness to its siblings.
The trees give log-odds that a node holds main text, one by one; taken alone they may keep a run in a dropped sidebar, or an empty
block. The choice is therefore made for the whole page at once, from the leaves up: a set of nodes with the largest sum of log-odds
such that a kept node's parent is kept and a kept block keeps something below. Kept runs are the text.

The trees (Spark ML) are fitted on labelled nodes of two kinds, both bounded: seeded layouts of invented words, marked up in many
ways, and a sample of the table's pages whose own markup says what they are (an article or main element, a nav or footer).
"""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siliscope.llm.common import small_batches, text_of
from siliscope.llm.page_dom import GROUPS, Page, features, parse
from siliscope.sources.staging import stage

#: bounds of the training table: seeded layouts, and pages of the table, those with the smallest hashes of their address
LAYOUTS = 700
SAMPLED_PAGES = 100
TREES, DEPTH, STEP = 30, 5, 0.3
#: log-odds beyond this size count as this size, so that no single node outweighs a page
SURE = 4.0
#: nodes judged at once
NODES = 50_000
_MARK = "\ue000"
_CONTENT = 1 << GROUPS.index("content")


# ---- labelled layouts

# fixed values: class and id names pages use for their parts, and words that parts show
_NAMES = {
    "menu": ("menu", "main-menu", "navbar", "nav-links", "breadcrumb", "pagination", "site-navigation"),
    "header": ("header", "site-header", "masthead", "topbar", "page-header"),
    "footer": ("footer", "site-footer", "colophon", "footer-legal", "copyright"),
    "sidebar": ("sidebar", "side-bar", "widget-area", "related-posts", "recommended", "right-rail", "trending"),
    "notice": ("cookie-banner", "cookie-notice", "gdpr-consent", "newsletter", "alert", "modal", "subscribe-box", "notice"),
    "advert": ("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"),
    "comment": ("comments", "comment-list", "reader-comments", "discussion", "replies"),
    "share": ("share", "social-links", "share-buttons", "post-meta", "tags"),
    "content": ("content", "post-content", "article-body", "entry-content", "main", "story", "post"),
}
_TAGS = {"menu": ("nav",), "header": ("header",), "footer": ("footer",), "sidebar": ("aside",), "notice": ("dialog", "aside"), "advert": ("aside",),
         "comment": ("section",), "share": ("ul",), "content": ("article", "main", "section")}
_PLAIN = ("row", "wrap", "container", "col", "inner", "grid", "block", "x1", "box")
_SYLLABLES = "re st on er in at es th ou an ti ed ing ly ble ha or en de la que ver sch au ción ra ó é ü wh mo lu pi ka zo".split()


class _Layout:
    """One invented page; main text carries a mark that the labels are read from."""

    def __init__(self, seed: int):
        self.pick = random.Random(seed)
        self.style = self.pick.choice(("tags", "words", "both", "bare", "both"))
        self.closing = self.pick.random() < 0.7
        self.noise = self.pick.random() < 0.15

    def word(self) -> str:
        word = "".join(self.pick.choice(_SYLLABLES) for _ in range(self.pick.choice((1, 1, 2, 2, 3, 4))))
        return word + self.pick.choice(("%%%", "***", "&amp;&amp;", "$$")) if self.noise and self.pick.random() < 0.6 else word

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.pick.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        left, out = self.pick.randint(low, high), []
        while left > 0:
            n = min(left, self.pick.randint(2, 24))
            out.append(self.words(n, n).capitalize().replace(" ", ", ", n > 8) + self.pick.choice("...?!"))
            left -= n
        return " ".join(out)

    def element(self, group: str, inside: str, hint: float = 1.0) -> str:
        """A part of the page under a tag or a name that gives its role away, or under neither."""
        styled = self.style if self.pick.random() < hint else "bare"
        tag = self.pick.choice(_TAGS[group]) if styled in ("tags", "both") else "div"
        if styled in ("words", "both"):
            name = self.pick.choice(_NAMES[group])
        else:
            name = self.pick.choice(_PLAIN) if self.pick.random() < 0.4 else ""
        return f'<{tag}{f" {self.pick.choice(("class", "class", "id"))}={chr(34)}{name}{chr(34)}" if name else ""}>{inside}</{tag}>'

    def wrapped(self, inside: str) -> str:
        for _ in range(self.pick.choice((0, 0, 1, 2, 3))):
            inside = f'<div class="{self.pick.choice(_PLAIN)}">{inside}</div>'
        return inside

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.pick.randint(low, high))]
        shape = self.pick.choice(("list", "list", "plain", "blocks"))
        if shape == "list":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if shape == "plain" else "".join(f"<div>{i}</div>" for i in items)

    def form(self) -> str:
        return (f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q">' + f"<p>{self.prose(3, 15)}</p>" * (self.pick.random() < 0.4)
                + f"<button>{self.words(1, 2)}</button></form>")

    def advert(self) -> str:
        inside = self.pick.choice((lambda: self.prose(3, 20), lambda: f'<a href="/x">{self.words(2, 8)}</a>', lambda: f"<p>{self.prose(4, 25)}</p>"))()
        return self.element("advert", inside)

    def notice(self) -> str:
        return self.element("notice", f"<p>{self.prose(6, 30)}</p><button>{self.words(1, 2)}</button>" if self.pick.random() < 0.6 else self.prose(5, 25))

    def comments(self) -> str:
        one = lambda: f'<div class="{self.pick.choice(("comment", "comment-body", "reply"))}"><b>{self.words(1, 2)}</b><p>{self.prose(3, 60)}</p></div>'
        listed = "".join(one() for _ in range(self.pick.randint(1, 6)))
        head = f"<h3>{self.words(1, 3)}</h3>" if self.pick.random() < 0.7 else ""
        style, self.style = self.style, self.pick.choice(("words", "both"))  # readers' comments are told apart by names alone
        out = self.element("comment", head + listed + (self.form() if self.pick.random() < 0.4 else ""))
        self.style = style
        return out

    def sidebar(self) -> str:
        parts = [f"<h3>{self.words(1, 3)}</h3>", self.links(2, 8)]
        if self.pick.random() < 0.4:
            parts.append(f"<p>{self.prose(4, 25)}</p>")
        return self.element("sidebar", "".join(parts))

    def article(self) -> str:
        mark, parts = lambda text: _MARK + text, []
        if self.pick.random() < 0.9:
            title = f"<h1>{mark(self.words(2, 12).capitalize())}</h1>"
            parts.append(f"<header>{title}</header>" if self.style != "bare" and self.pick.random() < 0.1 else title)
        if self.pick.random() < 0.2:
            parts.append(self.element("share", f"<li>{self.words(1, 3)}</li>" * 3))
        for _ in range(self.pick.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = self.pick.random()
            if kind < 0.62:
                text = self.prose(1, self.pick.choice((6, 40, 150)))
                if self.pick.random() < 0.25:
                    text += f' <a href="/l">{self.words(1, 3)}</a> {self.words(1, 6)}'
                if self.pick.random() < 0.15:
                    text = f"<b>{text}<br>"
                elif self.pick.random() < 0.1:
                    text = f"<em>{text}</em>"
                parts.append(f"<p>{mark(text)}" + "</p>" * (self.closing or self.pick.random() < 0.5))
            elif kind < 0.70:
                parts.append(f"<h2>{mark(self.words(1, 8))}</h2>")
            elif kind < 0.76:
                parts.append("<ul>" + "".join(f"<li>{mark(self.prose(1, 20))}</li>" for _ in range(self.pick.randint(2, 6))) + "</ul>")
            elif kind < 0.80:
                parts.append(f"<blockquote><p>{mark(self.prose(5, 40))}</p></blockquote>")
            elif kind < 0.83:
                row = lambda: "<tr>" + "".join(f"<td>{mark(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>"
                parts.append("<table>" + "".join(row() for _ in range(3)) + "</table>")
            elif kind < 0.86:
                parts.append(f"<pre>{mark(self.words(3, 30))}</pre>")
            elif kind < 0.90:
                parts.append(f"<div>{mark(self.prose(4, 60))}</div>")
            elif kind < 0.95:
                parts.append(self.advert())
            else:
                parts.append(self.pick.choice((self.notice, self.form, self.sidebar))())
        if self.pick.random() < 0.12:
            parts.append(self.comments())
        return self.element("content", "".join(parts), 0.85)

    def page(self) -> str:
        chance = lambda p, part: part() if self.pick.random() < p else ""
        menu = lambda: self.element("menu", self.links(2, 9))
        top = chance(0.5, lambda: self.element("header", f'<a href="/">{self.words(1, 3)}</a>' + chance(0.6, lambda: f"<p>{self.pick.choice((self.words, self.prose))(2, 8)}</p>") + chance(0.5, menu)))
        before = [top, chance(0.6, menu), chance(0.35, self.notice), chance(0.5, self.advert), chance(0.2, self.form), chance(0.2, self.sidebar)]
        after = [chance(0.4, self.sidebar), chance(0.45, self.comments), chance(0.3, self.advert), chance(0.2, self.notice), chance(0.15, self.form)]
        self.pick.shuffle(after)
        foot = chance(0.8, lambda: self.element("footer", self.pick.choice((
            lambda: "&copy; " + self.words(1, 12), lambda: f"<p>&copy; {self.prose(3, 15)}</p>", lambda: self.links(2, 8) + f"<p>{self.words(3, 10)}</p>"))()))
        middle = self.article() if self.pick.random() < 0.96 else ""
        if self.pick.random() < 0.3:
            middle = f"<main>{middle}</main>"
        body = "".join(before) + self.wrapped(middle + "".join(after)) + foot
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><script>var a="</p>";</script></head><body>{self.wrapped(body)}</body></html>'


def layout(seed: int) -> str:
    return _Layout(seed).page()


def marked_labels(page: Page) -> list[int]:
    """1 for nodes with marked text at or below them, else 0; the marks are taken out of the texts."""
    labels = [0] * len(page.parent)
    for at in range(len(labels) - 1, -1, -1):
        if _MARK in page.text[at]:
            page.text[at] = page.text[at].replace(_MARK, "")
            labels[at] = 1
        if labels[at] and at:
            labels[page.parent[at]] = 1
    return labels


def stated_labels(page: Page) -> list[int]:
    """What a page's own markup says: 1 for runs in an article or main element, 0 in a part of another role, -1 where it says nothing.
    A block is 1 if it holds such a run, and 0 in another part."""
    labels = [-1] * len(page.parent)
    article = [False] * len(labels)
    for at in range(1, len(labels)):
        article[at] = article[page.parent[at]] or bool(page.by_tag[at] & _CONTENT)
        if page.role[at] == 2:
            labels[at] = 0
        elif page.role[at] == 1 and article[at] and page.kind[at] == 1:
            labels[at] = 1
    for at in range(len(labels) - 1, 0, -1):
        if labels[at] == 1:
            labels[page.parent[at]] = 1
    return labels


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, labels = [], []
        for seed, markup in zip(batch.column("seed").to_pylist(), batch.column("html").to_pylist()):
            page = parse(layout(seed) if markup is None else markup)
            labels.append(marked_labels(page) if markup is None else stated_labels(page))
            pages.append(page)
        if pages:
            rows, label = features(pages), np.concatenate(labels)
            hold = label >= 0
            values = rows[hold]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel())),
                 pa.array(label[hold].astype(float))], ["features", "label"])


def training_nodes(spark: SparkSession, pages: DataFrame | None = None, layouts: int = LAYOUTS, sample: int = SAMPLED_PAGES,
                   url: str = "url", html: str = "html") -> DataFrame:
    """``features, label`` per labelled node of ``layouts`` invented pages and at most ``sample`` pages of the table."""
    seeds = spark.range(layouts).select(F.col("id").alias("seed"), F.lit(None).cast("string").alias("html"))
    if pages is not None:
        chosen = pages.filter(F.col(f"`{html}`").isNotNull()).select(F.xxhash64(F.col(f"`{url}`").cast("string")).alias("h"), F.col(f"`{html}`").alias("html"))
        seeds = seeds.unionByName(chosen.orderBy("h", "html").limit(sample).select(F.lit(-1).cast("bigint").alias("seed"), "html"))
    return seeds.repartition(8).mapInArrow(_training_rows, "features array<double>, label double")


# ---- trees

@dataclass
class Model:
    """Boosted trees as arrays: a node compares one feature with a threshold or, with feature -1, adds its value."""
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    deepest: int

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.deepest):
                feature = self.feature[at]
                less = rows[each, np.maximum(feature, 0)] <= self.threshold[at]
                at = np.where(feature < 0, at, np.where(less, self.low[at], self.high[at]))
            total += self.value[at]
        return 2 * total


_TREE = re.compile(r"Tree \d+ \(weight ([^)]+)\)")
_IF = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


def read_trees(description: str) -> Model:
    """The trees of a fitted model from its published description (``toDebugString``)."""
    feature, threshold, low, high, value, roots, deepest = [], [], [], [], [], [], 0
    lines = iter([line.strip() for line in description.splitlines()[1:] if line.strip()])

    def node(line: str, weight: float, depth: int) -> int:
        nonlocal deepest
        at, deepest = len(feature), max(deepest, depth)
        for column in (feature, threshold, low, high, value):
            column.append(0)
        if line.startswith("Predict:"):
            feature[at], value[at] = -1, weight * float(line.split(":")[1])
            return at
        found = _IF.match(line)
        feature[at], threshold[at] = int(found.group(1)), float(found.group(2))
        low[at] = node(next(lines), weight, depth + 1)
        next(lines)  # Else
        high[at] = node(next(lines), weight, depth + 1)
        return at

    for line in lines:
        roots.append(node(next(lines), float(_TREE.match(line).group(1)), 0))
    return Model(np.array(feature), np.array(threshold, float), np.array(low), np.array(high), np.array(value, float), np.array(roots), deepest)


def fit(spark: SparkSession, pages: DataFrame | None = None, layouts: int = LAYOUTS, sample: int = SAMPLED_PAGES, url: str = "url", html: str = "html") -> Model:
    """Trees fitted on the labelled nodes of ``training_nodes``; equal tables give equal trees up to the order of Spark's sums."""
    nodes = stage(training_nodes(spark, pages, layouts, sample, url, html)).select(array_to_vector("features").alias("features"), "label")
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=32).fit(nodes.coalesce(2))
    return read_trees(boosted.toDebugString)


# ---- decoding

def kept_nodes(parent: list[int], is_run: list[bool], scores: np.ndarray) -> list[bool]:
    """The set of nodes with the largest sum of scores in which parents of kept nodes are kept and no kept block is empty.

    ``parent`` of node 0 is -1; the page itself counts nothing. Blocks without a run below are never kept.
    """
    n = len(parent)
    gain, best = [0.0] * n, [float("-inf")] * n
    value = np.clip(scores, -SURE, SURE).tolist()
    value[0] = 0.0
    for at in range(n - 1, 0, -1):  # children come after their parent
        own = value[at] if is_run[at] else value[at] + (gain[at] if gain[at] > 0 else best[at])
        value[at], up = own, parent[at]
        if own > 0:
            gain[up] += own
        if own > best[up]:
            best[up] = own
    kept = [False] * n
    kept[0] = gain[0] > 0
    heirs = [-1] * n  # the best child of a block none of whose children gains by itself
    for at in range(n - 1, 0, -1):
        up = parent[at]
        if gain[up] <= 0 and value[at] == best[up] > float("-inf"):
            heirs[up] = at
    for at in range(1, n):
        kept[at] = kept[parent[at]] and (value[at] > 0 or heirs[parent[at]] == at)
    return kept


def main_text(page: Page, scores: np.ndarray) -> str:
    kept = kept_nodes(page.parent, [kind == 1 for kind in page.kind], scores)
    return "\n".join(page.text[at] for at in range(len(kept)) if kept[at] and page.kind[at] == 1)


def extract(pages: DataFrame, model: Model | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the main text of each in a new column ``text``; without a model one is fitted on the table (see ``fit``).

    The project writes pages of HTML but keeps no table of them, so the operator is general: any table with an address
    (only read to choose training pages) and the markup of each page. The text is the article without menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and readers' comments; character references are decoded, white space inside a
    block (line breaks included) is one space, blocks stand in page order with one \\n between. Nothing is cut.

    A null or empty page, or one without main text, gives an empty text. Rows that repeat are treated alike, each for itself; an
    empty table gives no rows. Other columns are kept as they are; a column ``text`` of the table is replaced.
    """
    spark = pages.sparkSession
    small_batches(pages)
    fitted = model or fit(spark, pages, url=url, html=html)
    names = [c for c in pages.columns if c != "text"]
    markup, kept = "html", [f"c{i}" for i in range(len(names))]
    rows = pages.select(text_of(f"`{html}`").alias(markup), *[F.col(f"`{n}`").alias(k) for n, k in zip(names, kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, nodes = [], [], 0
            for source in batch.column(markup):
                held.append(parse(source.as_py()))
                nodes += len(held[-1].parent)
                if nodes >= NODES:
                    texts += _texts(held, fitted)
                    held, nodes = [], 0
            texts += _texts(held, fitted)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(texts, pa.string())], [*kept, "text"])

    schema = T.StructType([T.StructField(k, pages.schema[n].dataType) for n, k in zip(names, kept)] + [T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(n) for n, k in zip(names, kept)], "text")


def _texts(pages: list[Page], model: Model) -> list[str]:
    if not pages:
        return []
    scores, at, out = model.log_odds(features(pages)), 0, []
    for page in pages:
        out.append(main_text(page, scores[at:at + len(page.parent)]))
        at += len(page.parent)
    return out
