"""Pages as small trees of blocks, as arrays: what the text extraction reads of a page's markup.

Nodes are block elements and runs: a run is what stands inside one block without another block between, links and other inline
markup included. Nodes are numbered in page order, a parent before its children; node 0 is the page.
"""
from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

# fixed values: elements by their role in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp svg math object audio video canvas".split())
PASSED = frozenset("html head body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl menu dir".split())
ITEMS = frozenset("li dd dt".split())
CELLS = frozenset("table thead tbody tfoot tr td th caption colgroup".split())
QUOTES = frozenset("blockquote pre figure figcaption address details summary".split())
CONTROLS = frozenset("form fieldset legend button select option optgroup label datalist output".split())
BOXES = frozenset("div section article main nav header footer aside center hgroup dialog noscript template search".split())
BLOCKS = frozenset({"p"} | HEADINGS | LISTS | ITEMS | CELLS | QUOTES | CONTROLS | BOXES)
#: what an element's start ends, if that is open above the given bounds
ENDS = {"li": ({"li"}, LISTS), "dd": ({"dd", "dt"}, LISTS), "dt": ({"dd", "dt"}, LISTS), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: start tags inside a paragraph that do not end it
IN_PARAGRAPH = frozenset({"button", "label", "select", "option", "optgroup", "datalist", "output"})
KINDS = ("page", "run", "paragraph", "heading", "list", "item", "cell", "quote", "control", "box")
GROUPS = ("menu", "header", "footer", "sidebar", "notice", "advert", "form", "comment", "share", "content")
TAG_GROUPS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "dialog": "notice", "noscript": "notice",
              "form": "form", "fieldset": "form", "button": "form", "select": "form", "label": "form", "legend": "form", "option": "form",
              "search": "form", "article": "content", "main": "content"}
ATTRIBUTE_WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager paginator tabs toc skip",
    "header": "header masthead topbar branding logo banner hero",
    "footer": "footer foot copyright colophon legal contentinfo imprint bottom",
    "sidebar": "sidebar aside rail widget widgets related recommended recommendations trending popular complementary more",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription paywall message dialog alertdialog",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted promos adsense adslot adbox",
    "form": "form search login signin signup register contact input field poll survey",
    "comment": "comment comments commentlist disqus reply replies respond discussion thread feedback reviews",
    "share": "share sharing social follow tweet facebook twitter tools toolbar meta tags tag byline",
    "content": "article content post entry main story body text prose page",
}
_TAG_BIT = {tag: 1 << GROUPS.index(group) for tag, group in TAG_GROUPS.items()}
_WORD_BIT = {word: 1 << i for i, group in enumerate(GROUPS) for word in ATTRIBUTE_WORDS[group].split()}
_CONTENT = 1 << GROUPS.index("content")
_KIND = {tag: KINDS.index(kind) for kind, tags in (("paragraph", {"p"}), ("heading", HEADINGS), ("list", LISTS), ("item", ITEMS), ("cell", CELLS),
                                                  ("quote", QUOTES), ("control", CONTROLS), ("box", BOXES)) for tag in tags}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass
class Page:
    """Columns of the nodes. Groups are bit sets over GROUPS; ``outer`` joins those of all ancestors, ``role`` says what the nearest
    node with a group, itself or an ancestor, stands for: 1 for content alone, 2 for any other group, 0 if there is none."""
    parent: list[int] = field(default_factory=lambda: [-1])
    end: list[int] = field(default_factory=lambda: [1])
    depth: list[int] = field(default_factory=lambda: [0])
    place: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [0])
    tag: list[int] = field(default_factory=lambda: [0])
    by_tag: list[int] = field(default_factory=lambda: [0])
    by_word: list[int] = field(default_factory=lambda: [0])
    outer: list[int] = field(default_factory=lambda: [0])
    role: list[int] = field(default_factory=lambda: [0])
    children: list[int] = field(default_factory=lambda: [0])
    text: list[str] = field(default_factory=lambda: [""])
    link_chars: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, kind: int, tag: int, by_tag: int, by_word: int, text: str = "", link_chars: int = 0) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.depth.append(self.depth[parent] + 1)
        self.place.append(self.children[parent])
        self.children[parent] += 1
        self.kind.append(kind)
        self.tag.append(tag)
        self.by_tag.append(by_tag)
        self.by_word.append(by_word)
        self.outer.append(self.outer[parent] | self.by_tag[parent] | self.by_word[parent])
        groups = by_tag | by_word
        self.role.append(self.role[parent] if not groups else 1 if groups == _CONTENT else 2)
        self.children.append(0)
        self.text.append(text)
        self.link_chars.append(link_chars)
        return at


_TAG_NUMBER = {tag: i + 2 for i, tag in enumerate(sorted(BLOCKS))}


def attribute_groups(attributes: str) -> int:
    """Groups that the words of class, id, role, itemprop and aria-label belong to."""
    found = 0
    for value in _ATTRIBUTE.findall(attributes):
        for word in _WORDS.findall(value):
            found |= _WORD_BIT.get(word.lower(), 0)
    return found


def parse(markup: str) -> Page:
    """The tree of a page. Missing and stray end tags are borne as browsers do; comments, scripts, styles and the title are left out."""
    page = Page()
    open_tags: list[str] = []
    open_nodes: list[int] = []  # node of a block, -1 for inline markup
    box, links = 0, 0
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            run.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                page.add(box, 1, 1, 0, 0, text, min(linked, len(text)))
            linked = 0

    def close(depth: int) -> None:
        """Close all that is open from this place of the stack on."""
        nonlocal box, links
        if any(node >= 0 for node in open_nodes[depth:]):
            flush()
            for node in open_nodes[depth:]:
                if node >= 0:
                    page.end[node] = len(page.parent)
            del open_nodes[depth:]
            box = next((node for node in reversed(open_nodes) if node >= 0), 0)
        else:
            del open_nodes[depth:]
        links -= open_tags[depth:].count("a")
        del open_tags[depth:]

    def last(names, bounds=()) -> int:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i] in names:
                return i
            if open_tags[i] in bounds:
                return -1
        return -1

    at, size = 0, len(markup)
    while at < size:
        found = _MARKUP.search(markup, at)
        if found is None:
            run.append(markup[at:])
            if links:
                linked += size - at
            break
        if found.start() > at:
            run.append(markup[at:found.start()])
            if links:
                linked += found.start() - at
        at = found.end()
        ending, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            if tag in BLOCKS:
                where = last((tag,), ("table",) if tag not in CELLS else ())
                if tag in HEADINGS and where < 0:
                    where = last(HEADINGS)
                if where >= 0:
                    close(where)
                elif tag == "p":
                    flush()
            elif tag == "br":
                run.append(" ")
            elif tag not in PASSED:
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_nodes[i] >= 0:
                        break
                    if open_tags[i] == tag:
                        links -= tag == "a"
                        del open_tags[i], open_nodes[i]
                        break
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(markup, at)
            at = markup.find(">", stop.end()) + 1 or size if stop else size
            continue
        if tag in PASSED:
            continue
        if tag in BLOCKS:
            if tag not in IN_PARAGRAPH and (where := last(("p",), ("button", "td", "th", "table"))) >= 0:
                close(where)
            while tag in ENDS and (where := last(*ENDS[tag])) >= 0:
                close(where)
            flush()
            box = page.add(box, _KIND[tag], _TAG_NUMBER[tag], _TAG_BIT.get(tag, 0), attribute_groups(attributes) if "=" in attributes else 0)
            open_tags.append(tag)
            open_nodes.append(box)
        elif not attributes.endswith("/"):
            if tag == "a":
                if (where := last(("a",), BLOCKS)) >= 0:
                    close(where)
                links += 1
            open_tags.append(tag)
            open_nodes.append(-1)
    flush()
    for node in open_nodes:
        if node >= 0:
            page.end[node] = len(page.parent)
    page.end[0] = len(page.parent)
    return page


NUMBERS = ("log_chars", "log_words", "link_share", "chars_per_run", "chars_per_node", "stops_per_word", "word_length", "runs", "share_of_page",
           "share_of_parent", "starts_at", "ends_at", "depth", "place", "siblings", "same_tag_share", "sibling_log_chars", "paragraph_share",
           "content_elsewhere", "other_words_below", "within_content", "within_other")
FEATURES = (*[f"tag_{g}" for g in GROUPS], *[f"word_{g}" for g in GROUPS], *[f"outer_{g}" for g in GROUPS], *[f"is_{k}" for k in KINDS],
            *[f"parent_is_{k}" for k in KINDS], *NUMBERS)


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, in order; columns as FEATURES. Sums over subtrees are differences of running totals."""
    sizes = np.array([len(p.parent) for p in pages], np.int64)
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)

    def column(name: str) -> np.ndarray:
        return np.array([v for p in pages for v in getattr(p, name)], np.int64)

    n = int(sizes.sum())
    parent = column("parent")
    is_page = parent < 0
    parent = np.where(is_page, np.arange(n), parent + base)
    end, kind, tag = column("end") + base, column("kind"), column("tag")
    texts = [t for p in pages for t in p.text]
    chars = np.array([len(t) for t in texts], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";") for t in texts], float)
    run = (kind == 1).astype(float)
    start = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[end] - total[start]

    all_chars, all_words, runs = below(chars), below(words), below(run)
    page_at = np.repeat(np.flatnonzero(is_page), sizes)
    page_chars = np.maximum(all_chars[page_at], 1)
    before = np.concatenate([[0.0], np.cumsum(chars)])[start] - np.concatenate([[0.0], np.cumsum(chars)])[page_at]
    by_tag, by_word, outer = column("by_tag"), column("by_word"), column("outer")
    children = np.array([c for p in pages for c in p.children], float)
    siblings = np.where(is_page, 1, children[parent])
    key = parent * 256 + tag
    _, inverse, same = np.unique(key, return_inverse=True, return_counts=True)
    content = ((by_tag & _CONTENT) > 0).astype(float)
    within = ((outer & _CONTENT) > 0) | (content > 0)
    other = (by_word & ~_CONTENT) > 0
    role = column("role")
    numbers = np.column_stack([
        np.log1p(all_chars), np.log1p(all_words), below(column("link_chars").astype(float)) / np.maximum(all_chars, 1),
        all_chars / np.maximum(runs, 1), all_chars / (end - start), below(stops) / np.maximum(all_words, 1), all_chars / np.maximum(all_words, 1), runs,
        all_chars / page_chars, all_chars / np.maximum(all_chars[parent], 1), before / page_chars, (before + all_chars) / page_chars,
        column("depth"), column("place"), siblings, same[inverse] / np.maximum(siblings, 1),
        np.log1p((all_chars[parent] - all_chars) / np.maximum(siblings - 1, 1)),
        below(run * chars * ((kind[parent] == 2) | (kind[parent] == 3))) / np.maximum(all_chars, 1),
        (below(content)[page_at] - below(content) > 0) & ~within, below(other.astype(float)) / (end - start), role == 1, role == 2])
    bits = np.arange(len(GROUPS))
    flags = [((m[:, None] >> bits) & 1).astype(float) for m in (by_tag, by_word, outer)]
    kinds = np.arange(len(KINDS))
    return np.column_stack([*flags, kind[:, None] == kinds, kind[parent][:, None] == kinds, numbers])
