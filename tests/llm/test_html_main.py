"""Main text of pages with known articles."""

import html as H
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnengine.llm import html_main as M

BODY = "<p>First, with commas, and a <a href='x'>link</a>.</p><p>Second &amp; last,<br>cut\n in two.</p>"
LINES = "First, with commas, and a link.\nSecond & last, cut in two."
MENU = "<a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a>"


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("  \n", ""),
        ("no markup, one line\nand more", "no markup, one line and more"),
        (f"<nav>{MENU}</nav><article><h1>T</h1>{BODY}</article><footer>&copy; somebody, somewhere</footer>", f"T\n{LINES}"),
        (f"<div id='menu'>{MENU}</div><div class='content'><h1>T</h1>{BODY}</div><div class='sidebar'><p>{'aside, ' * 60}</p></div>", f"T\n{LINES}"),
        (f"<div class=page><div class=top-nav>{MENU}</div><h1>T</h1><div class=text>{BODY}</div><div>{MENU}</div></div>", f"T\n{LINES}"),
        (f"<main><section><p>A, b.</p></section><section>{BODY}</section><section id=comments><article class=comment><p>{'me too, ' * 80}</p></article></section></main>", f"A, b.\n{LINES}"),
        (f"<article>{BODY}</article><div class='comment-list'><article><p>{'no, yes, ' * 90}</p></article></div>", LINES),
        (f"<form><div class=wrap><main>{BODY}<form>search <input></form></main></div></form>", LINES),
        (f"<body class='has-sidebar'>{BODY}<div class='cookie-notice'>We use cookies, a lot</div><div role=alert>!</div><p hidden>x</p>", LINES),
        (f"<article><header><h1>T</h1></header>{BODY}<ul>{MENU}</ul><ul><li>one<li>two</ul></article>", f"T\n{LINES}\none\ntwo"),
        ("<article><p><b>One.<br><p>Two.<br></article>", "One.\nTwo."),
        ("<article><p>a<script>if (a < b) { '</p>' }</script>b<style>p{}</style></p><!-- <p>no</p> --><p title='>'>c</p><p title=don't>d</p></article>", "ab\nc\nd"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut<p", "cut"),
        ("<article><p>cut<!-- open", "cut"),
        ("<article></article><footer>only this</footer>", ""),
        ("<article><p>x</p><table><tr><td>a<td>b<tr><th>c</table></article>", "x\na\nb\nc"),
        (f"<table><tr><td>{MENU}<td>{BODY}<td>Short</table>", f"{LINES}"),
        ("<article>x<svg/>y <b>z</p></b> w</article>", "xy z\nw"),
        (f"<article>{BODY}</article><article>{BODY}</article>", f"{LINES}\n{LINES}"),
        ("<div>" * 30000 + BODY, LINES),
    ],
)
def test_pages(page, expected):
    assert M.main_text(page) == expected


words = st.lists(st.sampled_from(["one", "two,", "<three>", "&", "çé", "a  b", "\t", "&lt;", "."]), min_size=1, max_size=12).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=8), st.booleans(), st.booleans())
def test_every_block_of_an_article_is_kept(blocks, closed, truncated):
    article = "".join(f"<p>{H.escape(b)}{'</p>' if closed else ''}" for b in blocks)
    page = f"<!DOCTYPE html><html><head><title>no</title></head><body><nav><ul><li>{MENU}</ul></nav><div class='ad'>no, no, no</div><article>{article}</article><footer>no</footer>" + ("" if truncated else "</body></html>")
    assert M.main_text(page) == "\n".join(t for b in blocks if (t := " ".join(b.split())))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a>", "</a>", "<b", "<!--", "-->", "<li>", "<ul>", "</ul>", "x, y", "'", '"', "=", ">", "<article>", "</article>", "<td>", "</table>", "<script>", "</script>", "<br/>", "&#0;", "<a b='"]), max_size=40))
def test_any_page_gives_a_text(parts):
    page = "".join(parts)
    tree = M.parse(page)
    assert all(0 <= p < i < e <= len(tree.tags) for i, (p, e) in enumerate(zip(tree.parents, tree.ends, strict=True)) if i)
    assert not re.search(r"[^\S\n ]|  ", M.main_text(page))


def test_rows(spark):
    long = "<article>" + BODY * 20_000
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<article>{BODY}"), (3, "u", long), (3, "u", long)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    found = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in M.extract_main(pages).collect())
    every = "\n".join([LINES] * 20_000)
    assert found == sorted([("1", "u", "", 0), ("2", None, "", 0), ("None", "u", LINES, len(LINES)), ("3", "u", every, len(every)), ("3", "u", every, len(every))], key=lambda r: r[0])
    assert M.extract_main(pages.limit(0)).count() == 0
