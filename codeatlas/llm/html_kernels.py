"""Trees of web pages: reading them, aligning two of them, and taking the main text, inside Spark tasks."""

from __future__ import annotations

import html
import math
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|object|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")  # name and value, from left to right
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of HTML: elements without content, elements inside a line of text, and elements that a sibling ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ENDS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
BLOCKS_THAT_END_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol",
    "p", "pre", "section", "table", "ul",
}
SCOPES = {"article", "main", "section", "div", "body", "td", "th", "li", "nav", "aside", "header", "footer", "form"}

# What marks a part of a page as no main text.
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "head", "button", "input", "dialog", "menu", "canvas", "audio", "video"}
SIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "search", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


class Node:
    __slots__ = ("tag", "label", "side", "kids", "up")

    def __init__(self, tag, label, side, up):
        self.tag, self.label, self.side, self.up, self.kids = tag, label, side, up, []


def parse(page: str) -> Node:
    """The tree of a page: nodes and strings; scripts, styles, comments and declarations are left out."""
    root = at = Node("#root", "#root", False, None)
    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            text = m.group()
            if m.group(1) is None and (text[0] != "<" or text == "<"):
                at.kids.append(text)
            continue
        tag = tag.lower()
        if m.group(2):
            spot = at
            while spot is not None and spot.tag != tag:
                # An end tag closes what is open inside its element; it doesn't reach out of the parts of a page.
                spot = None if spot.tag in SCOPES and tag not in SCOPES and tag not in ("ul", "ol", "table", "html") else spot.up
            if spot is not None and spot.up is not None:
                at = spot.up
            continue
        if tag in BLOCKS_THAT_END_P or tag in ENDS:
            closing = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS_THAT_END_P else set())
            spot, found = at, None
            while spot is not None and spot.tag not in SCOPES | {"ul", "ol", "table", "blockquote"} | closing:
                spot = spot.up
            if spot is not None and spot.tag in closing:
                found = spot
            if found is not None:
                at = found.up
        names, side = "", tag in SIDE_TAGS
        attributes = m.group(4)
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                if name == "class" or name == "id":
                    parts = [x.lower() for x in NAME_PART.findall(value)]
                    side = side or (tag not in ("body", "html", "article", "main") and any(x in SIDE_NAMES for x in parts))
                    names += "." + "-".join(parts) if name == "class" else ""
                elif name == "role":
                    side = side or value.lower() in SIDE_ROLES
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    side = True
        node = Node(tag, tag + names, side, at)
        at.kids.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            at = node
    return root


class Shape:
    """A tree with equal neighbours put together: `label`, `spelled`, the real nodes, child shapes, a number in reading order, and
    the number of shapes in it."""

    __slots__ = ("label", "spelled", "nodes", "kids", "number", "size")


def shape_of(root: Node) -> tuple[Shape, str, list[Shape]]:
    """The shape of a tree, its spelling, and all shapes in order of their numbers.

    Neighbouring children of equal spelling are one shape (a list of paragraphs or links counts as one place), so trees that
    differ in the lengths of their lists have one shape.
    """
    spelled: dict[int, str] = {}
    order, stack = [], [root]
    while stack:  # children before parents, without recursion: pages can be nested deeply
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if not isinstance(k, str))
    for node in reversed(order):
        parts, last = [], None
        for kid in node.kids:
            if not isinstance(kid, str):
                s = spelled[id(kid)]
                if s != last:
                    parts.append(s)
                last = s
        text = f"{node.label}({','.join(parts)})"
        spelled[id(node)] = text if len(text) < 4000 else f"{node.label}#{hash(text)}"
    top = Shape()
    top.label, top.spelled, top.nodes = root.label, spelled[id(root)], [root]
    found, todo = [], [top]
    while todo:
        shape = todo.pop()
        shape.number, shape.kids = len(found), []
        found.append(shape)
        # All nodes of a shape are spelled alike, so their groups of children stand side by side.
        for node in shape.nodes:
            spot, last = -1, None
            for kid in node.kids:
                if isinstance(kid, str):
                    continue
                s = spelled[id(kid)]
                if s != last:
                    spot, last = spot + 1, s
                    if spot == len(shape.kids):
                        new = Shape()
                        new.label, new.spelled, new.nodes = kid.label, s, []
                        shape.kids.append(new)
                shape.kids[spot].nodes.append(kid)
        todo.extend(reversed(shape.kids))
    for shape in reversed(found):
        shape.size = 1 + sum(kid.size for kid in shape.kids)
    return top, spelled[id(root)], found


def align(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest set of pairs of nodes (numbers in a and b) with equal labels that keeps parents and order.

    Sizes of matchings are found once for each pair of spellings, children before parents and without recursion, so trees may
    have any depth.  Equal children at the start and end of two lists are paired at once; what lies between is matched row by
    row, of which only every so many are kept and the others made again on the way back, so memory follows the length of
    a list times the root of it.
    """
    if a.label != b.label:
        return 0, []
    scores: dict[tuple[str, str], int] = {}
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if x.spelled == y.spelled:
            scores[x.spelled, y.spelled] = x.size
        if (x.spelled, y.spelled) in scores:
            stack.pop()
            continue
        start, end = _equal_ends(x.kids, y.kids)
        left, right = x.kids[start : len(x.kids) - end], y.kids[start : len(y.kids) - end]
        others = {k.spelled: k for k in right}.values()
        missing = [(p, q) for p in {k.spelled: k for k in left}.values() for q in others if p.label == q.label and (p.spelled, q.spelled) not in scores]
        if missing:
            stack.extend(missing)
            continue
        scores[x.spelled, y.spelled] = 1 + sum(k.size for k in x.kids[:start] + x.kids[len(x.kids) - end :]) + (_Rows(left, right, scores).score if left and right else 0)
        stack.pop()
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x.number, y.number))
        n, m = len(x.kids), len(y.kids)
        start, end = _equal_ends(x.kids, y.kids)
        stack.extend(zip(x.kids[:start] + x.kids[n - end :], y.kids[:start] + y.kids[m - end :]))
        if min(n, m) > start + end:
            stack.extend(_Rows(x.kids[start : n - end], y.kids[start : m - end], scores).matched())
    return scores[a.spelled, b.spelled], pairs


def _equal_ends(left: list[Shape], right: list[Shape]) -> tuple[int, int]:
    """How many children at the start, and of the others at the end, are spelled alike in both lists."""
    most, start, end = min(len(left), len(right)), 0, 0
    while start < most and left[start].spelled == right[start].spelled:
        start += 1
    while end < most - start and left[-1 - end].spelled == right[-1 - end].spelled:
        end += 1
    return start, end


class _Rows:
    """Rows of the table of best matchings of the first i of `left` with the first j of `right`, `score` in the last corner."""

    def __init__(self, left: list[Shape], right: list[Shape], scores: dict[tuple[str, str], int]):
        self.left, self.right, self.scores, self.weights = left, right, scores, {}
        self.step = math.isqrt(len(left)) + 1
        row = np.zeros(len(right) + 1, np.int32)
        self.kept = [row]
        for i in range(1, len(left) + 1):
            row = self.following(row, i)
            if i % self.step == 0:
                self.kept.append(row)
        self.score = int(row[-1])

    def weight(self, i: int) -> np.ndarray:
        """Sizes of the matchings of child i (from 1) with each of the right."""
        mine = self.left[i - 1]
        if mine.spelled not in self.weights:
            if len(self.weights) * len(self.right) > 1 << 20:
                self.weights.clear()
            found = (x.size if x.spelled == mine.spelled else self.scores.get((mine.spelled, x.spelled), 0) for x in self.right)
            self.weights[mine.spelled] = np.fromiter(found, np.int32, len(self.right))
        return self.weights[mine.spelled]

    def following(self, row: np.ndarray, i: int) -> np.ndarray:
        out = row.copy()
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + self.weight(i)), out=out[1:])
        return out

    def matched(self) -> list[tuple[Shape, Shape]]:
        found, j = [], len(self.right)
        for block in range(len(self.kept) - 1, -1, -1):
            first = block * self.step
            rows = [self.kept[block]]
            for i in range(first + 1, min(first + self.step, len(self.left)) + 1):
                rows.append(self.following(rows[-1], i))
            i = len(rows) - 1
            while i and j:
                size = self.weight(first + i)[j - 1]
                if size and rows[i][j] == rows[i - 1][j - 1] + size:
                    i, j = i - 1, j - 1
                    found.append((self.left[first + i], self.right[j]))
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return found


def line_part(node: Node) -> list[Node]:
    """A block and the elements inside its lines."""
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        found.append(at)
        stack.extend(k for k in reversed(at.kids) if not isinstance(k, str) and k.tag in INLINE)
    return found


def own_text(shape: Shape) -> str:
    """Text of a block without the blocks in it; empty for what stands inside a line, which goes with its block."""
    if shape.nodes[0].tag in INLINE:
        return ""
    return plain(" ".join(k for node in shape.nodes for part in line_part(node) for k in part.kids if isinstance(k, str)))


def plain(text: str) -> str:
    return " ".join(text.split())


class Aligner:
    """Alignments with references; pages of one shape share one."""

    def __init__(self):
        self.references: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], dict[int, int]] = {}

    def reference(self, page: str):
        if page not in self.references:
            if len(self.references) > 512:
                self.references.clear()
                self.pairs.clear()
            top, spelling, shapes = shape_of(parse(page))
            self.references[page] = top, spelling, [own_text(s) for s in shapes]
        return self.references[page]

    def match(self, page: str, reference: str):
        """(tree, shapes, place in the reference of each shape, texts of the reference)."""
        root = parse(page)
        top, spelling, shapes = shape_of(root)
        known, known_spelling, texts = self.reference(reference)
        key = spelling, known_spelling
        if key not in self.pairs:
            if len(self.pairs) > 4096:
                self.pairs.clear()
            self.pairs[key] = dict(align(top, known)[1])
        return root, shapes, self.pairs[key], texts


def constant_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (host, html, reference) to (host, place, seen, same): pages with a text at a place of the host's reference, and
    those whose text there is the reference's.  Pages that agree in all places tell nothing and aren't counted."""
    aligner = Aligner()
    for frame in batches:
        counts: dict[tuple[str, int], list[int]] = {}
        for host, page, reference in zip(frame.host, frame.html, frame.reference):
            if page is None or reference is None or page == reference:
                continue
            _, shapes, pairs, texts = aligner.match(page, reference)
            found = [(pairs[s.number], own_text(s)) for s in shapes if s.number in pairs]
            found = [(place, text) for place, text in found if text or texts[place]]
            if all(text == texts[place] for place, text in found):
                continue
            for place, text in found:
                entry = counts.setdefault((host, place), [0, 0])
                entry[0] += 1
                entry[1] += text == texts[place]
        yield pd.DataFrame([(h, p, *c) for (h, p), c in counts.items()], columns=["host", "place", "seen", "same"])


def main_text(root: Node, drop: set[int]) -> str:
    """Text of the article: of all `article` elements, else of `main`, else of the page, without side parts and without the nodes
    in `drop` (by id)."""
    roots = chosen(root, lambda n: n.tag == "article") or chosen(root, lambda n: n.tag == "main" or n.label.startswith("#main")) or [root]
    blocks, line = [], []

    def close():
        text = plain(html.unescape("".join(line)))
        line.clear()
        if text:
            blocks.append(text)

    for top in roots:
        stack = [(top, 0)]
        while stack:
            node, spot = stack.pop()
            if spot == 0 and (node.tag not in INLINE or node.tag == "br"):
                close()
            kids = node.kids
            while spot < len(kids):
                kid = kids[spot]
                spot += 1
                if isinstance(kid, str):
                    if id(node) not in drop:
                        line.append(kid)
                elif not kid.side:
                    stack.append((node, spot))
                    stack.append((kid, 0))
                    break
                elif kid.tag not in INLINE:
                    close()
            else:
                if node.tag not in INLINE:
                    close()
        close()
    return " ".join(blocks)


def chosen(root: Node, wanted: Callable[[Node], bool]) -> list[Node]:
    """Outermost nodes that are wanted and in no side part, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.side:
            continue
        if wanted(node):
            found.append(node)
        else:
            stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return found


def text_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (..., html, reference, constant) to (..., text): constant places of the host's reference are template and left out."""
    aligner = Aligner()
    for frame in batches:
        texts = []
        for page, reference, constant in zip(frame.html, frame.reference, frame.constant):
            if page is None:
                texts.append("")
                continue
            if reference is None or constant is None or not len(constant):
                texts.append(main_text(parse(page), set()))
                continue
            root, shapes, pairs, known = aligner.match(page, reference)
            fixed = set(constant)
            drop = {id(n) for s in shapes if pairs.get(s.number) in fixed and own_text(s) == known[pairs[s.number]] for block in s.nodes for n in line_part(block)}
            text = main_text(root, drop)
            texts.append(text or main_text(root, set()))  # a page made of template only is its own content
        yield frame.drop(columns=["html", "reference", "constant"]).assign(text=texts)
