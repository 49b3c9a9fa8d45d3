"""A forgiving HTML reader: block elements and text blocks of a page as a tree in page order, and their features."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)"""
    r"""|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?|["'])*+)(?:>|\Z))""", re.S)
NAMED = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw, and others of which nothing is read.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
SKIP = frozenset("audio button canvas datalist object select svg template video".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
#: What an opening tag closes first, and where the search for it ends.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
          "tbody": ("tbody thead tfoot caption", "table"), "thead": ("tbody thead tfoot caption", "table"), "tfoot": ("tbody thead tfoot caption", "table")}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}


def tokens(attributes: str) -> list[str]:
    """Lower-case words of class, id, role, itemprop and style; "hidden" where the element is."""
    out = []
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value:
            out.append("hidden")
        elif name not in ("style", "aria-hidden"):
            out += [w.lower() for w in PIECE.findall(value) if len(w) > 1]
    return out


class Forest:
    """Trees of many pages, node after node in page order. Leaves are text blocks."""

    def __init__(self):
        self.parent: list[int] = []
        self.end: list[int] = []
        self.tag: list[str] = []
        self.tokens: list[list[str]] = []
        self.text: list[str | None] = []  # of leaves
        self.linked: list[int] = []  # characters of a leaf that stand in links
        self.inner: list[int] = []  # inline tags in a leaf
        self.roots: list[int] = []

    def _node(self, parent: int, tag: str, words: list[str], text: str | None = None, linked: int = 0, inner: int = 0) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.tag.append(tag)
        self.tokens.append(words)
        self.text.append(text)
        self.linked.append(linked)
        self.inner.append(inner)
        return at

    def add(self, html: str) -> None:
        """One page: its root, then its nodes. White space in a block is one space; character references are decoded."""
        root = self._node(-1, "html", [])
        self.roots.append(root)
        stack, open_tags = [(root, "html")], {}
        run: list[str] = []
        link = link_home = 0  # characters of the run in links; the depth of the stack at which a link is open, or 0
        inner = 0
        absent: set[str] = set()  # raw elements that no longer end

        def flush() -> None:
            nonlocal run, link, inner
            if run:
                text = " ".join("".join(run).split())
                if text:
                    at, tag = stack[-1]
                    self._node(at, tag, [], text, min(link, len(text)), inner)
            run, link, inner = [], 0, 0

        def pop(depth: int) -> None:
            """Close all elements from this place in the stack on."""
            nonlocal link_home
            while len(stack) > depth:
                at, tag = stack.pop()
                self.end[at] = len(self.parent)
                open_tags[tag] -= 1
            if link_home > len(stack):
                link_home = 0

        def find(wanted: frozenset[str], limit: frozenset[str]) -> int:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in wanted:
                    return k
                if stack[k][1] in limit:
                    break
            return 0

        def say(text: str) -> None:
            nonlocal link
            if "&" in text:
                text = unescape(text)
            run.append(text)
            if link_home:
                link += len(text.strip())

        at = 0
        while True:
            m = TOKEN.search(html, at)
            if m is None:
                break
            if m.start() > at:
                say(html[at:m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name, closing = name.lower(), bool(m[1])
            if name in RAW or name in SKIP:
                if closing or m[3].endswith("/") and name in SKIP or name in absent:
                    continue
                over = re.compile(f"(?i)</{name}(?![a-z0-9])[^>]*>?").search(html, at)
                if over:
                    at = over.end()
                elif name in RAW:
                    at = len(html)
                else:
                    absent.add(name)
                continue
            if name in BLOCK:
                flush()
                if closing:
                    if open_tags.get(name, 0) or name in HEADING and stack[-1][1] in HEADING:
                        limit = frozenset(("td", "th", "table")) if name not in TABLE_PARTS else frozenset(("table",)) if name != "table" else frozenset()
                        k = find(HEADING if name in HEADING else frozenset((name,)), limit)
                        if k and name not in ("body", "html"):
                            pop(k)
                    continue
                if name == "hr" or name == "html" or name == "body" and open_tags.get("body"):
                    continue
                if stack[-1][1] == "p" or name in HEADING and stack[-1][1] in HEADING:
                    pop(len(stack) - 1)
                if name in CLOSES:
                    wanted, limit = CLOSES[name]
                    if any(open_tags.get(w) for w in wanted):
                        k = find(wanted, limit)
                        if k:
                            pop(k)
                stack.append((self._node(stack[-1][0], name, tokens(m[3]) if "=" in m[3] or "hidden" in m[3] else []), name))
                open_tags[name] = open_tags.get(name, 0) + 1
            elif name == "br":
                run.append(" ")
            else:
                inner += 1
                if name == "a":
                    link_home = 0 if closing else len(stack)
        if at < len(html):
            say(html[at:])
        flush()
        pop(1)
        self.end[root] = len(self.parent)


FEATURES = ["leaf", "depth", "chars", "words", "page_share", "link_share", "parent_link_share", "tag_density", "comma_rate", "sentence_rate", "digit_rate",
            "words_per_leaf", "leaves", "list_share", "paragraph_share", "heading_share", "tag_score", "attribute_score", "path_min", "path_max", "nearest", "below_min", "below_max",
            "sibling_place", "siblings", "sibling_same_tag", "sibling_share", "largest_share", "previous_chars", "next_chars", "previous_links", "next_links",
            "starts", "ends", "parent_page_share", "heading", "listed", "paragraph", "previous_alike", "next_alike", "alike_share"]


#: A score of at least this much, either way, tells something.
TELLING = 1.5


def subtree(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[end] - total[:-1]


def scores(forest: Forest, known: dict[str, float]) -> tuple[np.ndarray, ...]:
    """Own tag and attribute scores of nodes; the least, the greatest and the nearest telling one among ancestors; least and greatest below; depths.

    The page's root and body, which hold everything, tell nothing.
    """
    n = len(forest.parent)
    tag = [known.get(f"<{t}>", 0.0) for t in forest.tag]
    attribute = [0.0] * n
    low, high, near, depth = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    for k, (parent, words) in enumerate(zip(forest.parent, forest.tokens)):
        if words:
            found = [known[w] for w in words if w in known]
            if found:
                attribute[k] = max(found, key=abs)
        if parent >= 0:
            depth[k] = depth[parent] + 1
            if forest.tag[parent] not in ("html", "body"):
                low[k] = min(low[parent], tag[parent], attribute[parent])
                high[k] = max(high[parent], tag[parent], attribute[parent])
                own = attribute[parent] or tag[parent]
                near[k] = own if abs(own) >= TELLING else near[parent]
    under, over = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        parent = forest.parent[k]
        if parent >= 0 and forest.text[k] is None:
            under[parent] = min(under[parent], under[k], tag[k], attribute[k])
            over[parent] = max(over[parent], over[k], tag[k], attribute[k])
    return tuple(np.array(v, np.float64) for v in (tag, attribute, low, high, near, under, over, depth))


def features(forest: Forest, known: dict[str, float]) -> np.ndarray:
    """One row of ``FEATURES`` for each node."""
    n = len(forest.parent)
    parent, end = np.array(forest.parent, np.int64), np.array(forest.end, np.int64)
    leaf = np.array([t is not None for t in forest.text], bool)
    texts = pa.array([t or "" for t in forest.text], pa.large_string())
    size = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    chars = size(pc.utf8_length(texts))
    words = size(pc.count_substring(texts, " ")) + leaf
    per = {"comma": size(pc.count_substring_regex(texts, r"[,;、，]")), "sentence": size(pc.count_substring_regex(texts, r"[.!?。！？]")),
           "digit": size(pc.count_substring_regex(texts, r"[0-9]"))}
    linked, inner = np.array(forest.linked, np.float64), np.array(forest.inner, np.float64)
    tag = np.array(forest.tag, object)
    kinds = {"list": np.isin(tag, ["li", "dd", "dt"]), "paragraph": np.isin(tag, ["p", "blockquote", "pre"]), "heading": np.isin(tag, list(HEADING))}
    tag_score, attribute, low, high, near, under, over, depth = scores(forest, known)

    total = {name: subtree(v, end) for name, v in (("chars", chars), ("words", words), ("linked", linked), ("inner", inner + ~leaf), ("leaves", leaf), *per.items())}
    total |= {name: subtree(v & leaf, end) for name, v in kinds.items()}
    some = np.maximum(total["chars"], 1)
    leaves = np.maximum(total["leaves"], 1)
    root = np.array(forest.roots, np.int64)[np.searchsorted(forest.roots, np.arange(n), side="right") - 1]
    page = np.maximum(total["chars"][root], 1)
    links = total["linked"] / some
    up = np.where(parent < 0, np.arange(n), parent)

    # Siblings that hold text: places, neighbours and sums.
    held = total["leaves"] > 0
    order = np.flatnonzero(held & (parent >= 0))
    order = order[np.argsort(parent[order], kind="stable")]
    new = np.concatenate([[True], parent[order][1:] != parent[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    count = np.bincount(parent[order], minlength=n)
    place, previous, following = np.zeros(n), np.full(n, -1), np.full(n, -1)
    place[order] = (np.arange(len(order)) - first) / np.maximum(count[parent[order]] - 1, 1)
    joined = np.flatnonzero(~new)
    previous[order[joined]], following[order[joined - 1]] = order[joined - 1], order[joined]
    _, code = np.unique(tag.astype(str), return_inverse=True)
    pair = up * (code.max(initial=0) + 1) + code
    _, pair = np.unique(pair, return_inverse=True)
    alike = np.bincount(pair[order], minlength=pair.max(initial=0) + 1)[pair] / np.maximum(count[up], 1)
    alike_chars = np.bincount(pair[order], total["chars"][order], minlength=pair.max(initial=0) + 1)[pair]
    largest = np.zeros(n)
    np.maximum.at(largest, parent[order], total["chars"][order])
    at = lambda v, i: np.where(i < 0, 0.0, v[np.maximum(i, 0)])
    before = np.concatenate([[0.0], np.cumsum(chars)])[:-1]
    begin = before - before[root]
    log = np.log1p
    columns = [leaf, depth, log(total["chars"]), log(total["words"]), total["chars"] / page, links, links[up], total["inner"] / some * 100,
               *(total[k] / np.maximum(total["words"], 1) for k in per), log(total["words"] / leaves), log(total["leaves"]),
               total["list"] / leaves, total["paragraph"] / leaves, total["heading"] / leaves, tag_score, attribute, low, high, near, under, over,
               place, log(count[up]), alike, total["chars"] / np.maximum(total["chars"][up], 1), total["chars"] / np.maximum(largest[up], 1),
               at(log(total["chars"]), previous), at(log(total["chars"]), following), at(links, previous), at(links, following),
               begin / page, (begin + total["chars"]) / page, total["chars"][up] / page, kinds["heading"], kinds["list"], kinds["paragraph"],
               (previous >= 0) & (code[previous] == code), (following >= 0) & (code[following] == code), alike_chars / np.maximum(total["chars"][up], 1)]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)
