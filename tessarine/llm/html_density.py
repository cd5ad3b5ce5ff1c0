"""Main-content extraction from HTML by composite text density.

Every element of the page's tree has C characters of text, T descendant tags, LC
characters and LT tags inside links. Its composite density is

    C/T * log_b(C/LC * T/LT),   b = ln(C/(C-LC) * LC + LC_body/C_body * C + e)

(Sun, Song and Liao, 2011; zero denominators count as 1). Characters are counted after
entities are decoded, without white space. A node's density sum is the sum of its
children's densities, and its own density where it has no children. The node with the largest sum in ``body`` is the core; the
least density on the path from ``body`` down to it is the threshold. From ``body``, every
child whose density reaches the threshold is descended into where it holds the core, and
the subtree with the largest density sum among its nodes is marked as content.

The parser is a tolerant tokenizer: comments, declarations and the contents of script,
style and the like are dropped, void elements have no children, ``p``, ``li`` and table
cells close implicitly, stray end tags are ignored and open elements end with their
parents. A tag ends at the first ``>`` outside quotes; a quote that is never closed is a
character like any other. Where no such ``>`` follows, all the rest of the page is text.
Each character is looked at a bounded number of times, so long malformed pages cost time
in proportion to their length.

Defined results
---------------
* null or empty html, or html without text: empty text, 0 nodes or chars, density null.
* html without ``body``: the root stands for it.
* ties: the node that comes first in the document wins.
* repeated rows each give a row; empty tables give empty results; ids are untouched.
* extra columns are ignored. A result column called like the id column gets an underscore.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

#: A tag without quotes, the common case.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"'<]*)>")
_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
#: An element of the key's kind ends an open one of these, up to the nearest of the scope.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SPACE = re.compile(r"[ \t\r\n\f\v ]+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Node:
    """An element: its parts are nodes and strings in order."""

    __slots__ = ("tag", "parts", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _tag_end(html: str, at: int) -> int:
    """Where the tag's closing ``>`` is, from ``at`` inside the tag; -1 if nowhere."""
    while m := _STOP.search(html, at):
        at = m.end()
        if m.group() == ">":
            return m.start()
        closing = html.find(m.group(), at)
        if closing >= 0:
            at = closing + 1
    return -1


def parse(html: str) -> Node:
    root = Node("#root", None)
    stack = [root]  # the open elements
    depths: dict[str, list[int]] = {}  # by tag: where in the stack it is open, outermost first
    n, last_end = len(html), html.rfind(">")

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    at = 0
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            stack[-1].parts.append(unescape(html[at:start]))
            if start == n:
                break
        at = start
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith(("<!", "<?"), at) and at < last_end:
            at = html.find(">", at) + 1
            continue
        m = _PLAIN_TAG.match(html, at)
        if m:
            at, rest = m.end(), m.group(3)
        else:
            m = _OPENING.match(html, at)
            end = _tag_end(html, m.end()) if m and at < last_end else -1
            if m is None:
                stack[-1].parts.append("<")
                at += 1
                continue
            if end < 0:
                stack[-1].parts.append(unescape(html[at:]))
                break
            at, rest = end + 1, html[m.end() : end]
        name = m.group(2).lower()
        if m.group(1):
            if depths.get(name):
                close(depths[name][-1])
            continue
        if name in BLOCK and name != "br" and depths.get("p") and depths["p"][-1] == innermost(BLOCK):
            close(depths["p"][-1])
        if name in CLOSES:
            kinds, scope = CLOSES[name]
            limit = innermost(scope)
            inside = [depths[k][bisect_right(depths[k], limit)] for k in kinds if depths.get(k) and depths[k][-1] > limit]
            if inside:
                close(min(inside))
        node = Node(name, stack[-1])
        stack[-1].parts.append(node)
        if name in RAW:
            end = _ENDS[name].search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not rest.endswith("/"):
            depths.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


def nodes_of(root: Node) -> list[Node]:
    """In document order, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def composite(c: int, t: int, lc: int, lt: int, body_ratio: float) -> float:
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
    ratio = c / max(lc, 1) * (max(t, 1) / max(lt, 1))
    return c / max(t, 1) * (math.log(ratio) / math.log(base) if base > 1.0 and ratio > 0 else math.log(max(ratio, 1e-9)))


def measure(root: Node) -> tuple[Node, list[Node]]:
    """Counts and densities of all nodes; the body, and its nodes in document order."""
    nodes = nodes_of(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    nodes = nodes_of(body)
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, Node):
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
            else:
                node.chars += len(_SPACE.sub("", part))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node)) or (node.density if node.chars and not any(isinstance(p, Node) for p in node.parts) else 0.0)
    return body, nodes


def text_of(node: Node) -> str:
    """The text below a node: blocks on lines of their own, white space collapsed."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(_SPACE.sub(" ", part))
            continue
        if part.tag in BLOCK:
            out.append("\n")
            if part is not _BREAK:
                stack.append(_BREAK)
        stack.extend(reversed(part.parts))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


_BREAK = Node("br", None)


def extract(html: str | None) -> tuple[str, int, float | None, float | None]:
    """(text, nodes in the body, the core's density sum, threshold)."""
    if not html:
        return "", 0, None, None
    body, nodes = measure(parse(html))
    if not body.chars:
        return "", len(nodes), None, None
    core = max(nodes, key=lambda n: n.total)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    on_path = set(map(id, path))
    marked: list[Node] = []

    def children(node: Node) -> Iterator[Node]:
        return (p for p in node.parts if isinstance(p, Node) and p.density >= threshold and p.chars)

    if core is body:
        marked.append(body)
    else:
        stack = [children(body)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif id(child) in on_path and child is not core:
                stack.append(children(child))
            else:
                best = max(nodes_of(child), key=lambda n: n.total)
                marked.append(best if best.total > child.density else child)
    return "\n".join(filter(None, map(text_of, marked))), len(nodes), core.total, threshold


def extract_content(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_nodes, density_sum, threshold), a row for each page; nothing is shuffled."""

    @F.pandas_udf("text string, n_nodes long, density_sum double, threshold double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages_html in batches:
            out = pd.DataFrame([extract(h) for h in pages_html], columns=["text", "n_nodes", "density_sum", "threshold"])
            yield out.astype({"density_sum": "Float64", "threshold": "Float64", "n_nodes": "int64"})

    fields = ("text", "n_nodes", "density_sum", "threshold")
    found = pages.select(F.col(id_col).alias("__id"), run(F.col(html_col)).alias("__e"))
    return found.select(F.col("__id").alias(id_col), *[F.col(f"__e.{f}").alias(n) for f, n in zip(fields, named(id_col, fields))])
