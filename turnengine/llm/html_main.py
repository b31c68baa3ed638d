"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of blocks: runs of text between the bounds of block elements, with how much
of each is link text. Elements that are not content by their tag, role or class names are left out with all they hold.
Every block that is not a heading is a paragraph, and passes points for its length and commas, discounted by its share
of link text, to the elements around it: all of them to its container, half to the next, and a third, a sixth, ... further
up. Elements whose tag says what they are start with points of their own. The container with the most points, itself
discounted by its link density, is the article; if it lies in an article element, all of that is. Siblings are kept if
they score a fair part of the best, or are paragraphs, lists or headings with few links beside a container that no tag names.

Scale: one map over the pages, no shuffle; a task holds one batch of pages, and work and memory are linear in a page.

Defined cases: a null page is empty; a page without text outside of menus and the like gives an empty text; tags that
are cut off at the end of a page are not text; repeated rows are pages each; an empty table gives no rows; null page_id
and url stay null; further columns are not read. White space is what Unicode counts as such, no-break spaces included;
br is white space inside a block. Nothing is capped: very long pages are read whole, and nesting has no limit.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from turnengine.llm.common import ship

#: Elements that have no end tag, whose content is no markup, and at whose bounds a block ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content.
APART = frozenset(
    "script style noscript template head title nav footer aside form button select option datalist textarea input fieldset legend label menu dialog iframe object embed "
    "audio video canvas svg noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class names and ids of what is not content, and those before which such a word says nothing.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense adunit banner sponsor sponsored promo promoted promotion nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs masthead footer sidebar aside rail widget widgets notice notices cookie cookies consent gdpr popup modal overlay alert copyright newsletter "
    "subscribe subscription signup login form search social share sharing comment comments commentlist respond reply replies disqus discussion related recommended "
    "recommendations toolbar pagination pager skip".split()
)
NOT_SAID = frozenset("has with no without".split())
ARTICLE_NAMES = frozenset("article post entry story".split())
#: Points that a tag starts with, and least points of a sibling as a share of the best.
START = {"article": 50.0, "main": 30.0, "section": 3.0, "div": 3.0, "pre": 3.0, "blockquote": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0}
SIBLING = 0.2
#: Lists, tables and divisions of so many links and hardly other text are menus.
LINKS = 3
#: An open element of the first kind ends where one of its list begins, but not across the elements after the bar.
_ENDS = {
    "li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody", "table"), "option": ("option", "select"), "body": ("head", ""),
}
_CLOSED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،、，]")


def _says_apart(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is not content by what its tag and attributes say."""
    if tag in APART or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    found = {a.lower() or e.lower(): html.unescape(b or c or d) for a, b, c, d, e in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        for before, word in zip(["", *words], words, strict=False):
            if (word in NAMES and before not in NOT_SAID) or (word == "header" and not in_article and not ARTICLE_NAMES & set(words)):
                return True
    return False


@dataclass
class Tree:
    """A page: elements in page order (parents before children), whether each holds no other block element, and blocks
    (owner, text, length of link text)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    apart: list[bool] = field(default_factory=lambda: [False])
    ends: list[int] = field(default_factory=lambda: [0])
    leaf: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """The tree of a page; end tags that are missing are put where HTML implies them, those too many are ignored."""
    tree = Tree()
    open_ = [0]  # elements around here
    counts: dict[str, int] = {}  # of open_, by tag
    run: list[str] = []
    links = at = 0
    owners = [0]  # the open block elements

    def flush() -> None:
        nonlocal links
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                tree.blocks.append((owners[-1], text, min(links, len(text))))
            run.clear()
        links = 0

    def close() -> None:
        node = open_.pop()
        counts[tree.tags[node]] -= 1
        tree.ends[node] = len(tree.tags)
        if tree.tags[node] in BLOCKS:
            flush()
            owners.pop()

    def close_to(tags: frozenset[str], bar: frozenset[str], nearest: bool = False) -> None:
        """Close up to the outermost (or nearest) open element of these tags that is not beyond an element of bar; what
        is not a block does not close blocks around it."""
        depth = None
        for k in range(len(open_) - 1, 0, -1):
            if (tag := tree.tags[open_[k]]) in bar or (nearest and tag in BLOCKS and not tags & BLOCKS):
                break
            if tag in tags:
                depth = k
                if nearest:
                    break
        while depth is not None and len(open_) > depth:
            close()

    def text(upto: int) -> None:
        nonlocal links
        if upto > at:
            piece = page[at:upto]
            run.append(piece)
            if counts.get("a"):
                links += len(" ".join(piece.split()))

    position = 0
    while match := _TAG.search(page, position):
        text(match.start())
        at = position = match.end()
        tag = (match[2] or "").lower()
        if not tag or not match[4]:  # a comment, or cut off by the page's end
            continue
        attributes = match[3]
        if match[1]:
            if tag in BLOCKS:
                flush()
            if counts.get(tag):
                close_to(frozenset({tag}), frozenset(), nearest=True)
            continue
        if tag in BLOCKS and counts.get("p") and tag not in ("html", "body"):
            close_to(_P, _P_BAR)
        if tag in _CLOSED_BY and any(counts.get(t) for t in _CLOSED_BY[tag][0]):
            close_to(*_CLOSED_BY[tag])
        if tag == "a" and counts.get("a"):
            close_to(_A, _P_BAR)
        if tag in BLOCKS:
            flush()
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS and tag not in RAW):
            if tag in ("br", "hr"):
                run.append(" ")
            continue
        node = len(tree.tags)
        tree.tags.append(tag)
        tree.names.append(attributes)
        tree.parents.append(open_[-1])
        tree.apart.append(_says_apart(tag, attributes, bool(counts.get("article") or counts.get("main"))))
        tree.ends.append(0)
        tree.leaf.append(tag in BLOCKS)
        if tag in RAW:  # what it holds is no content of the page, whatever it looks like
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, position)
            at = position = end.end() if end else len(page)
            tree.ends[node] = node + 1
            continue
        open_.append(node)
        counts[tag] = counts.get(tag, 0) + 1
        if tag in BLOCKS:
            tree.leaf[owners[-1]] = False
            owners.append(node)
    text(len(page))
    flush()
    while len(open_) > 1:
        close()
    tree.ends[0] = len(tree.tags)
    return tree


_P, _A = frozenset({"p"}), frozenset({"a"})
#: Elements across which a start tag ends no paragraph and no link.
_P_BAR = frozenset("button td th caption table object".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SMALL = _HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote figure figcaption table".split())


def _kept_nodes(tree: Tree) -> list[bool]:
    """Which elements are content: what is apart takes all it holds with it, unless that holds the page's first main
    element, or its first article if it has none."""
    n, tags = len(tree.tags), tree.tags
    never = [False] * n
    for i in range(1, n):
        never[i] = never[tree.parents[i]] or (tags[i] in APART and tags[i] != "form") or (tree.apart[i] and tags[i] in ("article", "main"))
    first = next((i for tag in ("main", "article") for i in range(n) if tags[i] == tag and not never[i]), 0)
    around = set()
    while first > 0:
        around.add(first)
        first = tree.parents[first]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[tree.parents[i]] and (i in around or not tree.apart[i])
    return kept


def main_text(page: str | None) -> str:
    """The blocks of the page's article, a line each."""
    tree = parse(page or "")
    kept = _kept_nodes(tree)
    blocks = [b for b in tree.blocks if kept[b[0]]]
    if not blocks:
        return ""
    n, parents, tags = len(tree.tags), tree.parents, tree.tags
    points: list[float] = [0.0] * n
    length, linked, anchors = [0] * n, [0] * n, [int(t == "a") for t in tags]
    for owner, text, links in blocks:
        length[owner] += len(text)
        linked[owner] += links
        if tags[owner] in _HEADINGS:
            continue
        worth = (1 + len(_COMMA.findall(text)) + len(text) / 100) * (1 - links / len(text))
        node, level = (parents[owner] if tags[owner] in _SMALL or (tags[owner] == "div" and tree.leaf[owner]) else owner), 0
        while node >= 0 and level < 6:
            points[node] += worth / (1, 2, 6, 9, 12, 15)[level]
            node, level = parents[node], level + 1
    for i in range(n - 1, 0, -1):  # children come after their parents
        length[parents[i]] += length[i]
        linked[parents[i]] += linked[i]
        anchors[parents[i]] += anchors[i]
    density = [b / a if a else 0.0 for a, b in zip(length, linked, strict=True)]
    score = [(p + START.get(t, 0.0)) * (1 - d) if k and (a or t == "article") else -1.0 for p, t, d, k, a in zip(points, tags, density, kept, length, strict=True)]
    best = max(range(n), key=lambda i: (score[i], -i))
    around = best
    while around > 0 and tags[around] not in ("article", "main"):
        around = parents[around]
    named = around > 0
    best = around if named else best
    chosen = [(best, tree.ends[best])]
    if best:
        least = SIBLING * max(score[best], 1.0)
        for i in (j for j in range(best) if parents[j] == parents[best]), _later_siblings(tree, best):
            for j in i:
                if not kept[j] or not length[j] or density[j] >= 0.5:
                    continue
                same = tags[j] == tags[best] and tree.names[j] == tree.names[best] and tags[j] not in ("td", "th")
                if (named and tags[j] == tags[best] and score[j] >= least) or (not named and (same or tags[j] in _SMALL or points[j] * (1 - density[j]) >= least)):
                    chosen.append((j, tree.ends[j]))
        if not named:  # text that stands in the parent itself, beside the container
            chosen += [(parents[best], parents[best] + 1)]
    chosen.sort()
    menus = [(i, tree.ends[i]) for i in range(n) if tags[i] in ("ul", "ol", "dl", "div", "section", "table") and kept[i] and anchors[i] >= LINKS and density[i] > 0.8]
    inside = _inside(chosen)
    link_lists = _inside(menus)
    return "\n".join(text for owner, text, _ in blocks if inside(owner) and not link_lists(owner))


def _later_siblings(tree: Tree, node: int) -> Iterator[int]:
    at, stop = tree.ends[node], tree.ends[tree.parents[node]]
    while at < stop:
        yield at
        at = tree.ends[at]


def _inside(ranges: list[tuple[int, int]]):  # noqa: ANN202
    """A test for owners, asked in any order, of lying in one of the ranges (sorted by their start; they nest or are apart)."""
    outer: list[tuple[int, int]] = []
    for a, b in ranges:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
        elif b > outer[-1][1]:
            outer[-1] = (outer[-1][0], b)
    starts = [a for a, _ in outer]

    def test(owner: int) -> bool:
        k = bisect_right(starts, owner) - 1
        return k >= 0 and owner < outer[k][1]

    return test


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, EXTRACTED)
