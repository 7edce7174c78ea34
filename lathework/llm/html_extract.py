"""Main-text extraction from HTML by a tree-structured graphical model.

A page becomes a tree of its block elements. Each block is content or not: a log-linear potential of its own features (tag,
words of its class, id and role, length, link and sentence density) and one for each parent-child edge. Sum-product messages
go up the tree and down again and give every block's marginal; blocks whose marginal reaches 0.5 are the main text.

The potentials are trained here by maximum likelihood on labelled pages: `training_pages` writes pages in several layouts
and marks each block (attribute `data-y`), and the same messages give the expected counts of the gradient.

Pages are handled in batches whose trees lie in common arrays, so a message step is one array operation for a level of all
trees. Trees are never recursed into, so any depth works; what is nested over MOST_DEPTH deep joins the block at that depth.
Tags are found in linear time.

Edge cases: null and empty pages give an empty text; unclosed, stray and broken tags are mended as browsers mostly do; text
outside any tag belongs to the body; rows are independent, so repeated rows, null ids and extra columns change nothing; an
empty table gives an empty result. Whole pages are read and no text is cut.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import Shared, text_runs

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|data-y|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?,;:。！？]")

# Fixed values of HTML: elements without content, with raw text, inline ones, and which start tags end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style title xmp iframe noembed noframes head template svg math canvas object audio video select button textarea noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table td th ul ol dl div section article main aside".split())

TAGS = "html body main article section div p h1 h2 h3 ul ol li table tr td th blockquote pre figure figcaption dl dd dt nav header footer aside form fieldset center address details".split()
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
#: Words of class, id and role attributes that speak against and for content.
AGAINST = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs captcha combx comment comments commentlist community consent contact contentinfo cookie cookies copyright disqus disclaimer dialog discussion feedback follow footer form gdpr header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promoted promotion rail reader recommended related reply replies respond rss search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tweet warning alert widget widgets complementary".split())
FOR = frozenset("article articlebody blog body content copy entry hentry main page paragraph post prose story text".split())
N_FEATURES = 1 + len(TAGS) + 1 + 4 + 5 + 5 + 4 + 3
N_EDGES = 4
#: Blocks nested deeper become children of the one at this depth, as in browsers.
MOST_DEPTH = 512


class Markup:
    """Finds the tags of a page in linear time, however its quotes and brackets are broken.

    A tag ends at the first > outside quotes or, if its quotes never close, at the first >. Where a scan that stands before
    a quote ends depends on that quote alone, so it is kept and no part of the page is scanned again.
    """

    def __init__(self, page: str):
        self.page, self.ends, self.last = page, {}, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the > that ends the tag in which `at` stands; -1 if it never ends."""
        chain, page = [], self.page
        while True:
            m = STOP.search(page, at)
            if m is None:
                found = -1
            elif m[0] == ">":
                found = m.start()
            elif m.start() in self.ends:
                found = self.ends[m.start()]
            elif self.quotes[m[0]] == m.start():
                found = -1
            else:
                chain.append(m.start())
                at = page.find(m[0], m.start() + 1) + 1
                continue
            if m is not None and m[0] != ">":
                chain.append(m.start())
            self.ends.update(dict.fromkeys(chain, found))
            return found

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The next markup from `at` on: start, end, name (empty for comments and such), whether it closes, attributes."""
        page = self.page
        while True:
            a = page.find("<", at)
            if a < 0:
                return None
            if page.startswith("<!--", a):
                b = page.find("-->", a + 4)
                return a, len(page) if b < 0 else b + 3, "", False, ""
            if a > self.last:
                return None
            closes = page.startswith("/", a + 1)
            first = page[a + 1 + closes : a + 2 + closes]
            if first.isascii() and first.isalpha():
                b = self.end(a + 1)
                b = page.find(">", a) if b < 0 else b
                name = NAME.match(page, a + 1 + closes, b)[0]
                return a, b + 1, name, closes, page[a + 1 + closes + len(name) : b]
            if page[a + 1 : a + 2] in ("!", "?", "/"):
                return a, page.find(">", a) + 1, "", False, ""
            at = a + 1


class Batch:
    """Block trees of several pages in common lists."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.hint, self.label = [], [], [], [], []
        self.chars, self.linked, self.marks, self.own = [], [], [], []
        self.pieces: list[list[tuple[int, str]]] = []

    def block(self, parent: int, depth: int, tag: str, hint: tuple[int, int], label: int) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.tag.append(tag)
        self.hint.append(hint)
        self.label.append(label)
        self.chars.append(0)
        self.linked.append(0)
        self.marks.append(0)
        self.own.append(0)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        """Parse one page into blocks and text pieces."""
        pieces: list[tuple[int, str]] = []
        self.pieces.append(pieces)
        root = self.block(-1, 0, "body", (0, 0), 0)
        stack: list[tuple[str, int, bool]] = [("body", root, False)]  # tag, block, dropped
        where: dict[str, list[int]] = defaultdict(list)  # of each tag, its places in the stack but for the root
        scopes = [0]
        buffer: list[str] = []
        links = at = 0
        markup = Markup(page)

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                block = stack[-1][1]
                pieces.append((block, text))
                self.chars[block] += len(text)
                self.own[block] += len(text)
                self.marks[block] += len(SENTENCE.findall(text))

        def close(i: int) -> None:
            nonlocal links
            if any(t not in INLINE or self.tag[b] == t for t, b, _ in stack[i:]):
                flush()
            while len(stack) > i:
                tag = stack.pop()[0]
                where[tag].pop()
                links -= tag == "a"
                if scopes[-1] == len(stack):
                    scopes.pop()

        def push(tag: str, block: int, dropped: bool) -> None:
            where[tag].append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append((tag, block, dropped))

        while (m := markup.next(at)) is not None:
            a, b, name, closes, attributes = m
            if a > at and not stack[-1][2]:
                text = html.unescape(page[at:a])
                buffer.append(text)
                if links:
                    self.linked[stack[-1][1]] += len(text.strip())
            at = b
            if not name:
                continue
            name = name.lower()
            if closes:
                if where[name]:
                    close(where[name][-1])
                elif name not in INLINE:
                    flush()
                continue
            if name in VOID:
                if name == "br" or name == "hr":
                    buffer.append(" ")
                if name not in INLINE:
                    flush()
                continue
            ends = max((where[t][-1] for t in ENDS_SAME.get(name, ("p",) if name in ENDS_P else ()) if where[t]), default=0)
            if ends and ends >= scopes[-1]:
                close(ends)
            own = dict((k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)) if attributes else {}
            words = WORDS.findall(" ".join((own.get("class", ""), own.get("id", ""), own.get("role", ""))).lower()) if own else ()
            hint = (sum(w in AGAINST for w in words), sum(w in FOR for w in words))
            top, dropped = stack[-1][1], stack[-1][2] or name in DROPPED
            if name == "a":
                links += 1
            if name in INLINE and not (hint[0] and name != "a"):
                push(name, top, dropped)
            elif name in ("html", "body"):
                flush()
                if name == "body":  # a head left open ends here
                    close(1)
                    self.hint[root] = hint
                push(name, root, False)
            else:
                flush()
                if not dropped:
                    over = top if self.depth[top] < MOST_DEPTH else self.parent[top]
                    top = self.block(over, self.depth[over] + 1, name, hint, int(own.get("data-y", self.label[top])))
                push(name, top, dropped)
            if name in RAW:
                end = re.compile(f"</{name}", re.I | re.A).search(page, b)
                if end is None:
                    at = len(page)
                    break
                at = end.start()
        if at < len(page) and not stack[-1][2]:
            buffer.append(html.unescape(page[at:]))
        flush()


def _bucket(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


class Trees:
    """The arrays of a batch: active features of each block, edge kinds, levels."""

    def __init__(self, batch: Batch):
        self.parent, depth = np.array(batch.parent, np.int64), np.array(batch.depth, np.int64)
        self.levels = _levels(depth)
        chars, linked, marks, own = (np.array(x, float) for x in (batch.chars, batch.linked, batch.marks, batch.own))
        for level in self.levels[:0:-1]:
            for x in (chars, linked, marks):
                np.add.at(x, self.parent[level], x[level])
        tag = np.array([TAG_NUMBER.get(t, len(TAGS)) for t in batch.tag], np.int64)
        against, favour = np.array(batch.hint, np.int64).reshape(-1, 2).T
        density = linked / np.maximum(chars, 1)
        groups, at = [np.zeros(len(tag), np.int64)], 1
        for values, n in (
            (tag, len(TAGS) + 1), (np.minimum(against, 1) * 2 + np.minimum(favour, 1), 4), (_bucket(density, [0.01, 0.2, 0.5, 0.8]), 5),
            (_bucket(chars, [1, 25, 100, 400]), 5), (_bucket(own, [1, 25, 100]), 4), (_bucket(marks / np.maximum(chars, 1) * 100, [0.3, 1.5]), 3),
        ):
            groups.append(at + values)
            at += n
        self.features = np.stack(groups, axis=1)
        speaks = np.isin(tag, [TAG_NUMBER[t] for t in "nav header footer aside form fieldset".split()]) | ((against > 0) & (favour == 0))
        main = np.isin(tag, [TAG_NUMBER[t] for t in ("main", "article")]) | ((favour > 0) & (against == 0))
        plain = np.isin(tag, [TAG_NUMBER[t] for t in "p h1 h2 h3 ul ol li blockquote pre figure figcaption table tr td th dl dd dt".split()])
        self.edge = np.where(speaks, 0, np.where(main, 1, np.where(plain, 2, 3)))
        self.edge[self.parent < 0] = -1
        self.label = np.array(batch.label, np.int64)


@dataclass(frozen=True)
class Potentials:
    #: Log-odds of content for each feature.
    unary: np.ndarray
    #: For each edge kind, a log potential by the labels of parent and child.
    pair: np.ndarray


def marginals(trees: Trees, p: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Of each block, the chance that it is content; of each edge, the chances of both labels (parent, child)."""
    n = len(trees.parent)
    own = np.zeros((n, 2))
    own[:, 1] = p.unary[trees.features].sum(axis=1)
    up = np.zeros((n, 2))  # message of a block to its parent
    below = own.copy()
    for level in trees.levels[:0:-1]:
        up[level] = np.logaddexp.reduce(p.pair[trees.edge[level]] + below[level][:, None, :], axis=2)
        np.add.at(below, trees.parent[level], up[level])
    whole = below.copy()
    both = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        rest = whole[trees.parent[level]] - up[level]  # the parent without this child
        joint = rest[:, :, None] + p.pair[trees.edge[level]] + below[level][:, None, :]
        whole[level] = np.logaddexp.reduce(joint, axis=1)
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500))), both


def train(pages: list[str], steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Potentials:
    """Maximum likelihood by gradient steps (with a running scale for each parameter) on marked pages."""
    batch = Batch()
    for page in pages:
        batch.add(page)
    trees = Trees(batch)
    unary, pair = np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2))
    edges = trees.edge >= 0
    seen = np.zeros_like(pair)
    np.add.at(seen, (trees.edge[edges], trees.label[trees.parent[edges]], trees.label[edges]), 1)
    n, su, sp = len(trees.label), np.full(N_FEATURES, 1e-8), np.full(pair.shape, 1e-8)
    for _ in range(steps):
        chance, both = marginals(trees, Potentials(unary, pair))
        du = np.zeros(N_FEATURES)
        np.add.at(du, trees.features, (trees.label - chance)[:, None])
        dp = seen.copy()
        np.subtract.at(dp, trees.edge[edges], both[edges])
        du, dp = du / n - decay * unary, dp / n - decay * pair
        su, sp = su + du**2, sp + dp**2
        unary, pair = unary + rate * du / np.sqrt(su), pair + rate * dp / np.sqrt(sp)
    return Potentials(unary, pair)


def training_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Marked pages: semantic, class-named, table and bare layouts with all the parts that main text must be told from."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren tu sal ver do pin ga est or ul bre".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(said(2, 16) + rng.choice(".....!?") for _ in range(rng.randint(a, b)))

    def links(tag: str = "li", a: int = 3, b: int = 9) -> str:
        return "".join(f'<{tag}><a href="/{word()}">{said(1, 3)}</a></{tag}>' for _ in range(rng.randint(a, b)))

    def paragraphs() -> str:
        out = [f"<h1>{said(1, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            text = prose(1, rng.choice((1, 3, 8))) if rng.random() < 0.85 else said(1, 4)
            if kind < 0.7:
                out.append(f"<p>{rng.choice(('', '', '<em>', '<strong>', '<span>'))}{text}" + rng.choice(("</p>", "</p>", "</p>", "")))
            elif kind < 0.76:
                out.append(f"<h2>{said(1, 5)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{said(1, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.9:
                out.append(f"<table><tr><td>{said(1, 3)}</td><td>{said(1, 3)}</td></tr></table>")
            elif kind < 0.93:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.96:
                out.append(f'<p>{prose(1, 2)} <a href="/{word()}">{said(1, 3)}</a> {prose(1, 2)}</p>')
            else:
                out.append(f"<figure><figcaption>{said(2, 8)}</figcaption></figure>")
            if rng.random() < 0.06:
                out.append(boiler(rng.choice(("ad", "share", "form", "related", "notice"))))
        return "".join(out)

    names = {
        "ad": "ad ads advert sponsor banner promo", "share": "share social follow", "related": "related recommended teaser links", "notice": "cookie notice consent alert disclaimer",
        "menu": "nav menu navbar navigation topbar breadcrumb", "header": "header masthead banner", "footer": "footer copyright legal", "side": "sidebar rail widget", "comments": "comments comment discussion replies", "form": "form newsletter signup login search",
    }
    named = lambda kind: f'{rng.choice(("class", "id", "class"))}="{rng.choice(names[kind].split())}{rng.choice(("", "-box", "-1", " wide"))}"'

    def boiler(kind: str, style: str = "") -> str:
        style = style or rng.choice(("tag", "name", "name"))
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div") if style == "tag" else rng.choice(("div", "div", "section"))
        mark = f" {named(kind)}" if style == "name" or tag == "div" else ""
        inner = {
            "ad": lambda: rng.choice((prose(1, 2), f'<p>{said(2, 8)}</p>', f'<a href="/x">{said(2, 6)}</a>')),
            "share": lambda: f"<ul>{links()}</ul>", "related": lambda: f"<h3>{said(1, 3)}</h3><ul>{links()}</ul>",
            "notice": lambda: rng.choice((f"<p>{prose(1, 3)}</p><button>{word()}</button>", prose(1, 2))),
            "menu": lambda: rng.choice((f"<ul>{links()}</ul>", links("span"))), "header": lambda: rng.choice((f'<a href="/">{said(1, 2)}</a><p>{said(2, 6)}</p>', f"<h2>{said(1, 3)}</h2><ul>{links()}</ul>")),
            "footer": lambda: rng.choice((f"{said(1, 3)} {rng.randint(1995, 2024)}. {prose(1, 2)}", f"<p>&copy; {said(2, 8)}</p><ul>{links()}</ul>")),
            "side": lambda: f"<h3>{said(1, 3)}</h3><ul>{links()}</ul><p>{prose(1, 2)}</p>",
            "comments": lambda: f"<h3>{said(1, 3)}</h3>" + "".join(f'<div class="{rng.choice(("comment", "reply", "c"))}"><p>{prose(1, 4)}</p></div>' for _ in range(rng.randint(1, 5))),
            "form": lambda: f"<label>{said(1, 3)}</label><input name=q><p>{said(2, 9)}</p>",
        }[kind]()
        return f'<{tag}{mark} data-y="0">{inner}</{tag}>'

    out = []
    for i in range(n):
        layout = rng.choice(("semantic", "semantic", "named", "named", "bare", "table"))
        body = paragraphs()
        if layout == "semantic":
            main = f'<article data-y="1">{body}</article>'
            main = f"<main>{main}</main>" if rng.random() < 0.4 else main
        elif layout == "named":
            name = rng.choice(("content", "post-body", "entry", "article-text", "story", "main-content", "prose", "post content"))
            main = f'<div {rng.choice(("class", "id"))}="{name}" data-y="1">{body}</div>'
            main = f'<div class="{rng.choice(("wrapper", "row", "container"))}">{main}</div>' if rng.random() < 0.5 else main
        elif layout == "bare":
            main = f'<div data-y="1">{body}<p>{prose(*rng.choice(((2, 4), (4, 9))))}</p></div>'
        else:
            side = rng.choice((f"<ul>{links()}</ul>", links("b"), links("div"), f"<p>{said(1, 4)}</p>"))
            cells = [f'<td data-y="0">{side}</td>', f'<td data-y="1">{body}<p>{prose(*rng.choice(((2, 4), (4, 9))))}</p></td>']
            rng.shuffle(cells)
            rows = [f'<tr data-y="0"><td>{links("i", 2, 6)}</td></tr>' if rng.random() < 0.5 else "", f"<tr>{''.join(cells)}</tr>"]
            main = f"<table>{''.join(rows)}</table>"
        style = "tag" if layout == "semantic" and rng.random() < 0.7 else "name"
        pick = lambda kind, p: boiler(kind, style) if rng.random() < p else ""  # noqa: E731, B023
        out.append(
            f"<!DOCTYPE html><html><head><title>{said(2, 6)}</title><style>p{{}}</style></head><body>{pick('header', 0.5)}{pick('menu', 0.8)}{pick('notice', 0.3)}{pick('ad', 0.6)}"
            f"{pick('side', 0.2)}{main}{pick('ad', 0.2)}{pick('related', 0.3)}{pick('comments', 0.4)}{pick('side', 0.3)}{pick('form', 0.3)}{pick('footer', 0.9)}</body></html>"
        )
    return out


def main_texts(pages: list[str | None], p: Potentials) -> list[str]:
    batch = Batch()
    for page in pages:
        batch.add(page or "")
    keep = marginals(Trees(batch), p)[0] >= 0.5
    return [" ".join(text for block, text in pieces if keep[block]) for pieces in batch.pieces]


def extract_main_text(pages: DataFrame, trained: Potentials | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html", slice_bytes: int = 1 << 20) -> DataFrame:
    """The kept columns and text, the page's main text."""
    shared = Shared(pages.sparkSession, trained or train(training_pages()))
    rows = pages.select(*keep, F.col(html_column).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = shared.get()
        for batch in batches:
            *kept, html_ = batch.columns
            for start, run_ in text_runs(html_, slice_bytes):
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(run_)) for c in kept), pa.array(main_texts(run_.to_pylist(), potentials), pa.string())], names=[*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, text string")
