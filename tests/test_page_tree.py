"""Main text by tree densities: counts against a plain recursion, and pages of several shapes."""

import random
import re
from html import escape

from lodestone import queries
from lodestone.sources import page_tree

SF = "/root/testdata/sf0.001"


def rendered(spec):
    """HTML of a nested (tag, children) list; strings are texts."""
    if isinstance(spec, str):
        return escape(spec)
    tag, children = spec
    return f"<{tag}>" + "".join(rendered(c) for c in children) + ("" if tag in page_tree.VOID else f"</{tag}>")


def counted(spec, in_link=False):
    """Characters, link characters and elements of a specification, by plain recursion."""
    if isinstance(spec, str):
        n = len("".join(spec.split()))
        return n, n * in_link, 0
    tag, children = spec
    if tag in page_tree.UNSEEN:
        return 0, 0, 0
    parts = [counted(c, in_link or tag == "a") for c in children]
    return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts) + 1


def test_densities_against_plain_recursion():
    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["word ", "a & b < c ", "ünï ", " "])
        tag = rng.choice(["div", "section", "span", "b", "a", "ul", "script", "br", "em"])
        return (tag, [] if tag == "br" else ["x()"] if tag == "script" else [made(depth - 1) for _ in range(rng.randrange(4))])

    for _ in range(200):
        spec = ("div", [made(5) for _ in range(3)])
        node = page_tree.tree("<html><body>" + rendered(spec) + "</body></html>").children[0]
        chars, links, tags = counted(spec)
        assert (node.chars, node.links, node.tags) == (chars, links, tags - 1), rendered(spec)
        assert node.density == (chars - links) / max(1, tags - 1)


def test_article_among_boilerplate():
    menu = "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(30))
    html = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav>
    <div id=page><div class=side><ul>{menu}</ul></div><article><h2>Head &amp; line</h2><p>First paragraph of some length, with a <a href=x>link</a> inside.<p>Second paragraph, never closed &#8212; with an entity.
    <nav><a href=y>nested boilerplate</a></nav><script>var hidden = 1;</script><p>Third<br>line.</p><ul><li>An item of the text<li>Another item</ul></article></div><footer>Imprint and much more text about the company, its address and its history.</footer></body></html>"""
    assert page_tree.main_text(html).split("\n\n") == [
        "Head & line", "First paragraph of some length, with a link inside.", "Second paragraph, never closed — with an entity.", "Third line.", "An item of the text", "Another item",
    ]


def test_odd_pages():
    assert page_tree.main_text(None) == page_tree.main_text("") == page_tree.main_text("<script>x</script>") == ""
    assert page_tree.main_text("plain text &#x41;&lt;") == "plain text A<"
    assert page_tree.main_text("</div></p>text</b>") == "text"
    assert page_tree.main_text("<div>" * 5000 + "deep") == "deep"
    assert page_tree.main_text("<p>one<p>two") == "one\n\ntwo"
    assert page_tree.main_text("<p><a href=x>only a link</a></p><p>and some text beside</p>") == "and some text beside"


def test_query_over_the_whole_table(spark):
    rows = queries.QUERIES["html_tree_text"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        text = page_tree.main_text(pages[r["page_id"]])
        assert r["n_chars"] == len(text) and not re.search(r"<\w+>|\n\n\n", text)
