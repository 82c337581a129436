"""Main text of web pages by the densities of their tag tree.

A page becomes a tree of its elements. Every node knows the characters of its text, the
elements below it and the characters inside of links; its density is text outside of
links per element. The main part is the node whose children have the highest sum of densities (a
menu has little text for many elements, an article much for few), and what it says is
the text of its blocks, less boilerplate: elements such as ``nav`` and ``footer``, and blocks
that are mostly links. Arrow batches, one page at a time; no page is larger in memory
than its tree.

Defined results: elements that are never closed end where their parent does, or where an
element that cannot stand in them begins (a paragraph in a paragraph, an item in an
item). An end tag without a beginning is passed over. Named and numeric entities are
characters. A null, empty or textless page has an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end, those whose text is not shown, those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg iframe".split())
BLOCK = frozenset("address article blockquote body dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 li main ol p pre section table tbody td tfoot th thead tr ul form nav header footer aside".split())
#: Elements that end an open one of the second kind when they begin.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a closing search for the elements above does not look behind.
WALLS = frozenset("table ul ol dl div section article main body".split())
BOILERPLATE = frozenset("nav header footer aside form button select".split())
MOST_LINKS = 0.5


class Node:
    """An element with its text and elements below it."""

    __slots__ = ("chars", "children", "links", "parent", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.chars = self.links = self.tags = 0

    @property
    def density(self) -> float:
        return (self.chars - self.links) / max(1, self.tags)

    @property
    def density_sum(self) -> float:
        return sum(c.density for c in self.children if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        for_end, node = ENDS.get(tag, set()) | ({"p"} if tag in BLOCK else set()), self.at
        while node.parent is not None and node.tag not in WALLS:
            if node.tag in for_end:
                self.at = node.parent
                break
            node = node.parent
        made = Node(tag, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _order(root: Node) -> list[Node]:
    """Nodes, every parent before its children; no recursion, as pages may nest deeply."""
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def tree(html: str) -> Node:
    """The page's tree with the counts of every node."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    for node in reversed(_order(builder.root)):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(re.sub(r"\s", "", c))
            elif c.tag not in UNSEEN:
                node.chars += c.chars
                node.links += c.links
                node.tags += 1 + c.tags
        if node.tag == "a":
            node.links = node.chars
    return builder.root


def main_node(root: Node) -> Node:
    """The node of the highest sum of densities, of equals the outer one; boilerplate is not looked into."""
    best, left = root, [root]
    while left:
        node = left.pop(0)
        if node.density_sum > best.density_sum:
            best = node
        left += [c for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN | BOILERPLATE]
    return best


def blocks(node: Node) -> list[str]:
    """Texts of a node's blocks in order, without boilerplate and without blocks that are mostly links."""
    out: list[str] = []
    words: list[str] = []
    links = chars = 0

    def close() -> None:
        nonlocal links, chars
        text = " ".join("".join(words).split())
        if text and links <= MOST_LINKS * chars:
            out.append(text)
        words.clear()
        links = chars = 0

    left: list[tuple[Node | str | None, bool]] = [(node, False)]
    while left:
        item, in_link = left.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            words.append(item)
            n = len(re.sub(r"\s", "", item))
            chars += n
            links += n * in_link
        elif item.tag == "br":
            words.append("\n")
        elif item.tag not in UNSEEN and item.tag not in BOILERPLATE:
            edge = item.tag in BLOCK
            if edge:
                close()
                left.append((None, False))
            left += [(c, in_link or item.tag == "a") for c in reversed(item.children)]
    close()
    return out


def main_text(html: str | None) -> str:
    """The main part's blocks, with blank lines between."""
    return "\n\n".join(blocks(main_node(tree(html)))) if html else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in ``out``."""
    shape = [(f.name, f.dataType.simpleString()) for f in pages.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                texts = [main_text(h) for h in batch.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n, _ in shape], pa.array(texts, pa.string())], [*[n for n, _ in shape], out])

    return pages.select(*[F.col(f"`{n}`") for n, _ in shape]).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*shape, (out, "string")]))
