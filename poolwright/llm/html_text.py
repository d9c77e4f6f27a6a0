"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text at block-level tags. Features of a block are its words and
link density, those of the blocks before and after it, and what its containers are called. The
tree is trained on a small table of labelled blocks, which a seeded rule writes (``labelled_blocks``).
"""

from __future__ import annotations

import html as html_entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows

# fixed values: element names and container names
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset("script style noscript template title svg math iframe object textarea select option".split())
#: of these, the ones that hold raw text: without an end tag they reach to the end of the page
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr td th caption figcaption".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu topbar header masthead footer "
    "foot copyright sidebar aside widget related recommended share sharing social follow breadcrumb breadcrumbs pagination pager cookie cookies consent "
    "gdpr notice alert disclaimer newsletter subscribe subscription signup login paywall popup modal overlay comment comments reply replies respond "
    "disqus feedback search toolbar tags skip".split()
)
#: names that are of an article's own head inside an article
HEAD_NAMES = frozenset("header masthead topbar".split())
#: words that make a name one of several things: "tags-and-body", "post-with-sidebar"
JOINING = frozenset("and with has plus".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())

_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TAG = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    boiler: bool
    main: bool
    leaf: str

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@dataclass
class _Cutter:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    #: open containers: (tag, boilerplate so far, main so far, boilerplate by its element and not by a name)
    stack: list[tuple[str, bool, bool, bool]] = field(default_factory=lambda: [("", False, False, False)])
    leaf: str = ""
    link: bool = False
    #: elements from the outermost skipped one on, how many of each tag, and the same of those around it
    inside: list[str] = field(default_factory=list)
    skipped: Counter = field(default_factory=Counter)
    around: Counter = field(default_factory=Counter)

    def skip(self, tag: str) -> None:
        self.inside.append(tag)
        self.skipped[tag] += 1

    def skips_open(self, tag: str) -> bool:
        """Whether a skipped element holds a start tag; an option that is not in one ends at it."""
        if self.inside == ["option"]:
            self.end_skip()
        return bool(self.inside)

    def skips_close(self, tag: str) -> bool:
        """Whether an end tag is of something in a skipped element; that of an element around it ends it."""
        if self.skipped[tag]:
            last = ""
            while last != tag:
                last = self.inside.pop()
                self.skipped[last] -= 1
            return True
        if self.inside and (self.inside == ["option"] or self.around[tag]):
            self.end_skip()
        return bool(self.inside)

    def end_skip(self) -> None:
        self.inside.clear()
        self.skipped.clear()

    def text(self, s: str) -> None:
        if s and not self.inside:
            self.parts.append(s)
            if self.link:
                self.linked.append(s)

    def close_block(self) -> None:
        if self.parts:
            words = html_entities.unescape("".join(self.parts)).split()
            if words:
                linked = len(html_entities.unescape(" ".join(self.linked)).split())
                _, boiler, main, _ = self.stack[-1]
                self.blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), boiler, main, self.leaf))
            self.parts.clear()
        self.linked.clear()

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        if tag == "br":
            self.text(" ")
        if tag in INLINE:
            return
        self.close_block()
        if tag in VOID:
            return
        if tag in LEAVES:
            self.leaf = tag
            return
        self.leaf = ""
        _, boiler, main, by_tag = self.stack[-1]
        if tag in MAIN_TAGS:  # what a container around an article is called says nothing about the article
            self.stack.append((tag, by_tag, True, by_tag))
            return
        named_boiler = named_main = False
        if attributes and tag not in ("html", "body"):
            for m in _ATTR.finditer(attributes):
                for name in (m[2] or m[3] or m[4] or "").split():
                    parts = {x.lower() for x in _NAME.findall(name)}
                    if main:  # the head of an article is a part of it
                        parts -= HEAD_NAMES
                    if parts & BOILER_NAMES and not (parts & MAIN_NAMES and parts & JOINING):
                        named_boiler = True
                    elif parts & MAIN_NAMES:
                        named_main = True
        by_tag = by_tag or tag in BOILER_TAGS or (tag == "header" and not main)
        boiler = boiler or by_tag or named_boiler
        self.stack.append((tag, boiler, main or named_main and not boiler, by_tag))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in INLINE:
            return
        self.close_block()
        if tag in LEAVES:
            self.leaf = ""
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                self.leaf, self.link = "", False
                break


def cut_blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page in page order. Unclosed and stray tags are put up with."""
    if not page:
        return []
    cutter, at, n = _Cutter(), 0, len(page)
    low = page.lower() if page.isascii() else None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            cutter.text(page[at:])
            break
        m = _TAG.match(page, lt + 1)
        if m is None:
            if page.startswith("<!--", lt):
                cutter.text(page[at:lt])
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                cutter.text(page[at:lt])
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # no tag: ordinary text
                cutter.text(page[at : lt + 1])
                at = lt + 1
            continue
        cutter.text(page[at:lt])
        end = page.find(">", m.end())
        quote = None
        probe = m.end()
        while end >= 0:  # a > inside a quoted value does not end the tag
            for c in page[probe:end]:
                if quote is None and c in "\"'":
                    quote = c
                elif c == quote:
                    quote = None
            if quote is None:
                break
            closing = page.find(quote, end)
            if closing < 0:
                end = page.find(">", m.end())
                break
            probe, quote = closing + 1, None
            end = page.find(">", probe)
        if end < 0:
            break
        tag = m[1].lower()
        at = end + 1
        if page[lt + 1] == "/":
            if not cutter.skips_close(tag):
                if cutter.around[tag]:
                    cutter.around[tag] -= 1
                cutter.close(tag)
            continue
        holds = cutter.skips_open(tag)
        if page[end - 1] != "/" and tag in RAW and not (tag in ("textarea", "title") and (cutter.skipped["svg"] or cutter.skipped["math"])):
            stop = low.find(f"</{tag}", at) if low is not None else _find_close(page, tag, at)
            if tag != "title":
                cutter.text(" ")
            if stop < 0:
                break
            stop = page.find(">", stop)
            at = n if stop < 0 else stop + 1
            continue
        if holds or tag in SKIPPED and page[end - 1] != "/":
            if tag not in ("option", "select"):
                cutter.text(" ")
            if tag not in VOID and page[end - 1] != "/":
                cutter.skip(tag)
            continue
        if tag not in VOID:
            cutter.around[tag] += 1
        cutter.open(tag, page[m.end() : end])
        if page[end - 1] == "/" and tag not in INLINE and tag not in VOID:
            pass  # HTML ignores the slash of a self-closing element
    cutter.close_block()
    return cutter.blocks


def _find_close(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
    return m.start() if m else -1


def features(blocks: list[Block]) -> list[list[float]]:
    """Of each block: words, link density, the same of its neighbours, and its place."""
    out = []
    for k, b in enumerate(blocks):
        before = blocks[k - 1] if k else None
        after = blocks[k + 1] if k + 1 < len(blocks) else None
        out.append(
            [
                float(b.words),
                b.link_density,
                float(before.words) if before else 0.0,
                before.link_density if before else 0.0,
                float(after.words) if after else 0.0,
                after.link_density if after else 0.0,
                float(b.boiler),
                float(b.main),
                float(b.leaf == "p" or b.leaf.startswith("h")),
                float(before.main and not before.boiler) if before else 0.0,
                float(after.main and not after.boiler) if after else 0.0,
            ]
        )
    return out


# ---- the labelled table ------------------------------------------------------------------------
def _say(rng: random.Random, kind: str, least: int, most: int) -> str:
    return " ".join(f"{kind}{rng.randrange(900)}" for _ in range(rng.randint(least, most)))


def labelled_pages(seed: int = 11, pages: int = 400) -> list[str]:
    """Pages whose main text consists of words that start with c, and all other text of b."""
    rng = random.Random(seed)
    out = []
    for _ in range(pages):
        links = lambda n: "".join(f"<li><a href='#'>{_say(rng, 'b', 1, 3)}</a></li>" for _ in range(n))
        top = [f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f"<header><h1>{_say(rng, 'b', 1, 5)}</h1></header>"]
        top.append(f"<div class='menu'><ul>{links(4)}</ul></div><div><a href='#'>{_say(rng, 'b', 1, 4)}</a> <a href='#'>{_say(rng, 'b', 1, 3)}</a></div>")
        noise = [
            f"<div class='ad'>{_say(rng, 'b', 3, 25)}</div>",
            f"<aside><p>{_say(rng, 'b', 5, 40)}</p></aside>",
            f"<div id='cookie-notice'>{_say(rng, 'b', 8, 40)}</div>",
            f"<form>{_say(rng, 'b', 1, 8)}<button>{_say(rng, 'b', 1, 2)}</button></form>",
            f"<div class='related'><a href='#'>{_say(rng, 'b', 4, 12)}</a></div>",
            f"<section class='comments'><p>{_say(rng, 'b', 5, 60)}</p></section>",
        ]
        body = []
        for _ in range(rng.randint(1, 9)):
            p = _say(rng, "c", 1, 90)
            if rng.random() < 0.25:
                p += f" <a href='#'>{_say(rng, 'c', 1, 3)}</a> {_say(rng, 'c', 6, 30)}"
            elif rng.random() < 0.15:  # a paragraph that is mostly a link
                p = f"<a href='#'>{_say(rng, 'c', 5, 25)}</a> {_say(rng, 'c', 1, 4)}"
            body.append(f"<{t}>{p}</{t}>" if (t := rng.choice(["p", "p", "p", "li", "h2", "blockquote"])) else "")
        shape = rng.random()
        if shape < 0.5:
            tag = rng.choice(["article", "main"])
            # lists of links, named or not, stand in articles too
            listed = f"<ul>{links(rng.randint(3, 8))}</ul>"
            inside = rng.choice(["", rng.choice(noise), listed, f"<div>{listed}</div>"])
            main = f"<{tag}><h1>{_say(rng, 'c', 1, 12)}</h1>{''.join(body)}{inside}</{tag}>"
        elif shape < 0.75:
            main = f"<div class='{rng.choice(['content', 'post', 'entry-content', 'story'])}'><h1>{_say(rng, 'c', 1, 12)}</h1>{''.join(body)}</div>"
        else:  # nothing names the main text: words, links and elements decide
            main = "<div>" + "".join(f"<p>{_say(rng, 'c', 3, 90)}</p>" for _ in range(rng.randint(1, 6))) + "</div>"
        foot = rng.choice(["", "", f"<footer>{_say(rng, 'b', 3, 15)}</footer>", f"<div>{_say(rng, 'b', 1, 3)} <a href='#'>{_say(rng, 'b', 2, 7)}</a></div>", f"<div class='footer'><p>{_say(rng, 'b', 3, 15)}</p></div>"])
        if rng.random() < 0.15:  # hardly any markup
            linked = f"<p><a href='#'>{_say(rng, 'c', 5, 25)}</a> {_say(rng, 'c', 1, 4)}</p>"
            main = rng.choice(["<p>%s</p>", "%s", "<div>%s</div>"]) % _say(rng, "c", 1, 40) if rng.random() < 0.6 else f"<article>{''.join(body[:2])}{linked}</article>"
            top, noise, foot = [""], [""], ""
        top, noise = ["", *top], ["", "", *noise]
        out.append(f"<html><body>{rng.choice(top)}{rng.choice(noise)}{main}{rng.choice(noise)}{foot}</body></html>")
    return out


def labelled_blocks(seed: int = 11, pages: int = 400) -> tuple[list[list[float]], list[int]]:
    x, y = [], []
    for page in labelled_pages(seed, pages):
        blocks = cut_blocks(page)
        x += features(blocks)
        y += [int(b.text.startswith("c")) for b in blocks]
    return x, y


# ---- the tree ----------------------------------------------------------------------------------
Tree = tuple


def grow(x: list[list[float]], y: list[int], depth: int = 8, least: int = 4) -> Tree:
    """Decision tree by Gini impurity: (feature, threshold, below, above), or (share of main text,)."""

    def gini(pos: int, n: int) -> float:
        return 2.0 * pos * (n - pos) / n if n else 0.0

    pos = sum(y)
    best = None
    if depth and 0 < pos < len(y):
        for f in range(len(x[0])):
            order = sorted(range(len(y)), key=lambda i: x[i][f])
            left = 0
            for k in range(1, len(order)):
                left += y[order[k - 1]]
                a, b = x[order[k - 1]][f], x[order[k]][f]
                if a < b and least <= k <= len(order) - least:
                    impurity = gini(left, k) + gini(pos - left, len(order) - k)
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, (a + b) / 2)
    if best is None or best[0] >= gini(pos, len(y)) - 1e-12:
        return (pos / len(y) if y else 0.0,)
    _, f, t = best
    below = [i for i in range(len(y)) if x[i][f] <= t]
    above = [i for i in range(len(y)) if x[i][f] > t]
    return (f, t, *(grow([x[i] for i in part], [y[i] for i in part], depth - 1, least) for part in (below, above)))


def decide(tree: Tree, row: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    return grow(*labelled_blocks())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    tree = tree or trained_tree()
    blocks = cut_blocks(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row) >= 0.5)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null or empty page has an empty text.

    Each row is judged on its own: repeated rows each get a row, other columns of pages are not read.
    """
    tree = tree or trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    batch_rows(pages.sparkSession, 1000)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
