"""Main text of web pages: a bidirectional LSTM labels every block of a page with the whole page as context.

A page is read into its leaf sequence: runs of text between block-level tags, each with the elements it lies in. Every block becomes a vector of hashed
path elements (tags, class, id and role words), hashed words and some shares (letters, links, digits, place in the page); two LSTMs read the
sequence from both ends, and a block is main text where their joint score is at least one half.

No page is labelled, so labels are made. ``teacher`` marks blocks of at most ``SAMPLE`` given pages by what their elements say (article and main
against nav, aside, footer, form and class words); ``layouts`` sets sentences of these pages into variants of a page whose labels are known by construction: other wrappers, wrappers
without any hint, comments, notices, adverts and forms inside and outside of the article. The network learns from both.
Fitting is bounded by ``SAMPLE``, ``LAYOUTS`` and ``SPAN`` blocks of a page, and runs on the driver in numpy; labelling runs in tasks over all pages and whole pages.

Null html and pages without main text give the empty text; repeated rows give the same result each; a null page_id is kept. Malformed markup never
fails: an unclosed tag is text, an unclosed comment or script runs to the end, stray end tags are ignored. A page is read in time linear in its length, paths are kept as sets of at most
``PATHS`` numbers, and vectors are summed in pieces, so long pages and deep nesting need no more than their blocks. Other columns are not read; an empty table gives no rows, and a model fitted without pages knows layouts only.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from moteflow.llm.common import shards

SAMPLE, LAYOUTS, SPAN = 300, 1500, 200
PATHS, WORDS, SHARES = 256, 128, 10
FEATURES = PATHS + WORDS + SHARES
EMBED, HIDDEN = 24, 24

# Elements of HTML that begin a block, that end one another, and whose content is no text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(script|style|title|template|noscript|iframe|svg|textarea|object)\b{_ATTRIBUTES}>(?:.*?</\1\s*>|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

# What class, id and role words commonly say.
NOT_MAIN = frozenset("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar comment comments disqus reply replies respond cookie cookies consent notice alert popup modal newsletter subscribe signup login search share sharing social related recommended widget".split())
MAIN = frozenset("article content post entry story main".split())


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]
    tag: str
    linked: float
    label: bool


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATHS


def teacher(parent: int, tag: str, names: frozenset[str]) -> int:
    """What an element says of its blocks: 1 main text, -1 not, 0 nothing; what is not main text holds none."""
    if parent < 0 or tag in ("nav", "aside", "footer", "form", "menu", "dialog", "head", "button", "select", "label") or (tag == "header" and parent == 0) or names & NOT_MAIN:
        return -1
    return 1 if tag in ("article", "main") or names & MAIN else parent


def blocks(html: str) -> list[Block]:
    """The non-empty blocks of a page in their order."""
    out, stack = [], [("", frozenset(), 0)]
    parts, linked, total, anchor, at = [], 0, 0, 0, 0

    def flush():
        nonlocal linked, total
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            tag, path, says = stack[-1]
            out.append(Block(text, (*path, _slot("leaf " + tag)), tag, linked / max(total, 1), says > 0))
        linked = total = 0

    def leave(tags, walls=frozenset()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in walls:
                return

    open_ = {}
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            n = m.start() - at
            total += n
            linked += n if anchor else 0
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "a":
                anchor = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        anchor = 0
        if m[2]:
            if open_.get(tag):
                leave({tag})
                open_ = _counted(stack) if tag not in ("p", "li") else open_ | {tag: open_[tag] - 1}
            continue
        top = stack[-1][0]
        if top == "p" or (top in HEADINGS and tag in HEADINGS):
            stack.pop()
            open_[top] -= 1
        if tag in ENDS:
            size = len(stack)
            leave(*ENDS[tag])
            if len(stack) < size:
                open_ = _counted(stack)
        names = frozenset(w for v in _NAMES.findall(m[4]) for w in _WORD.findall("".join(v).lower())) if m[4] else frozenset()
        _, path, says = stack[-1]
        stack.append((tag, path | {_slot(tag), *map(_slot, ("." + n for n in names))}, teacher(says, tag, names)))
        open_[tag] = open_.get(tag, 0) + 1
    parts.append(html[at:])
    flush()
    return out


def _counted(stack: list) -> dict[str, int]:
    open_: dict[str, int] = {}
    for tag, _, _ in stack[1:]:
        open_[tag] = open_.get(tag, 0) + 1
    return open_


class _WordSlots(dict):
    """Memo of the features of words; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        slot = self[word] = PATHS + zlib.crc32(word) % WORDS
        return slot


def vectors(pages: list[list[Block]], slots: _WordSlots, piece: int = 4096) -> Iterator[np.ndarray]:
    """The feature vectors of all blocks of the pages, in pieces of at most ``piece`` rows: ones for path elements, word counts over the number of words, shares."""
    where, sizes, worth, shares = [], [], [], []

    def dense():
        row = np.repeat(np.arange(len(shares)).repeat(2), sizes)
        flat = np.bincount(row * FEATURES + np.array(where, np.int64), np.repeat(np.array(worth), sizes), len(shares) * FEATURES)
        out = flat.reshape(-1, FEATURES).astype(np.float32)
        out[:, PATHS + WORDS :] = shares
        return out

    for page in pages:
        last = max(len(page) - 1, 1)
        for i, b in enumerate(page):
            raw = b.text.encode()
            words = raw.lower().split()
            n = len(raw)
            marks, digits = n - len(raw.translate(None, b".,;:!?")), n - len(raw.translate(None, b"0123456789"))
            where.extend(b.path)
            where.extend(map(slots.__getitem__, words))
            sizes += len(b.path), len(words)
            worth += 1.0, 2 / (2 + len(words))
            shares.append((math.log1p(n) / 8, math.log1p(len(words)) / 6, b.linked, min(1.0, 10 * marks / n), digits / n, i / last, i == 0, i == last, 1 / len(page), 1.0))
            if len(shares) == piece or len(where) > 1_000_000:
                yield dense()
                where, sizes, worth, shares = [], [], [], []
    if shares:
        yield dense()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Packed:
    """Sequences side by side, longest first: at step t the first ``live[t]`` of them have a block, at ``rows[t]`` of the flat layout."""

    def __init__(self, sizes: np.ndarray, backward: bool):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        steps = int(sizes.max()) if len(sizes) else 0
        live = [int(np.searchsorted(-sizes[order], -t, "left")) for t in range(steps)]
        self.rows = [starts[order[:n]] + ((sizes[order[:n]] - 1 - t) if backward else t) for t, n in enumerate(live)]


def _run(packed: Packed, drive: np.ndarray, recur: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of an LSTM whose gates get ``drive`` from the input: input, forget, output and candidate, in this order."""
    size = recur.shape[0]
    out, trail = np.zeros((len(drive), size), np.float32), []
    h = c = np.zeros((len(packed.rows[0]) if packed.rows else 0, size), np.float32)
    for rows in packed.rows:
        h, c = h[: len(rows)], c[: len(rows)]
        z = drive[rows] + h @ recur
        gates, candidate = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        before = c
        c = f * c + i * candidate
        bent = np.tanh(c)
        if keep:
            trail.append((h, before, i, f, o, candidate, bent))
        h = o * bent
        out[rows] = h
    return out, trail


def _back(packed: Packed, trail: list, recur: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the drive and the recurrent weights from those of the states."""
    size = recur.shape[0]
    d_drive, d_recur = np.zeros((len(d_out), 4 * size), np.float32), np.zeros_like(recur)
    d_h = d_c = np.zeros((0, size), np.float32)
    for rows, (h, before, i, f, o, candidate, bent) in zip(reversed(packed.rows), reversed(trail), strict=True):
        more = np.zeros((len(rows) - len(d_h), size), np.float32)
        d_h, d_c = np.concatenate([d_h, more]) + d_out[rows], np.concatenate([d_c, more])
        d_c = d_c + d_h * o * (1 - bent * bent)
        d_z = np.concatenate([d_c * candidate * i * (1 - i), d_c * before * f * (1 - f), d_h * bent * o * (1 - o), d_c * i * (1 - candidate * candidate)], axis=1)
        d_drive[rows] = d_z
        d_recur += h.T @ d_z
        d_h, d_c = d_z @ recur.T, d_c * f
    return d_drive, d_recur


class Labeller:
    """Embedding of features, an LSTM from each end and a logistic output that also sees the embedding."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"embed": draw(FEATURES, EMBED) * 0.5, "out": draw(2 * HIDDEN + EMBED, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {f"in_{side}": draw(EMBED, 4 * HIDDEN), f"recur_{side}": draw(HIDDEN, 4 * HIDDEN), f"gate_{side}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def embedded(self, pages: list[list[Block]]) -> np.ndarray:
        """Embedding of the blocks of all pages."""
        out = [np.tanh(x @ self.w["embed"]) for x in vectors(pages, _WordSlots())]
        return np.concatenate(out) if out else np.zeros((0, EMBED), np.float32)

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """Probability of main text for each block of the pages, one after another."""
        e, sizes = self.embedded(pages), np.array([len(p) for p in pages if p])
        sides = [_run(Packed(sizes, s == "b"), e @ self.w[f"in_{s}"] + self.w[f"gate_{s}"], self.w[f"recur_{s}"], False)[0] for s in "fb"]
        return _sigmoid(np.concatenate([*sides, e], axis=1) @ self.w["out"] + self.w["bias"])[:, 0]

    def _gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, e = self.w, np.tanh(x @ self.w["embed"])
        packed = {s: Packed(sizes, s == "b") for s in "fb"}
        run = {s: _run(packed[s], e @ w[f"in_{s}"] + w[f"gate_{s}"], w[f"recur_{s}"], True) for s in "fb"}
        top = np.concatenate([run["f"][0], run["b"][0], e], axis=1)
        d = (_sigmoid(top @ w["out"] + w["bias"]) - y[:, None]).astype(np.float32) / len(y)
        g, d_top = {"out": top.T @ d, "bias": d.sum(axis=0)}, d @ w["out"].T
        d_e = d_top[:, 2 * HIDDEN :].copy()
        for k, s in enumerate("fb"):
            d_drive, g[f"recur_{s}"] = _back(packed[s], run[s][1], w[f"recur_{s}"], d_top[:, k * HIDDEN : (k + 1) * HIDDEN])
            g[f"in_{s}"], g[f"gate_{s}"] = e.T @ d_drive, d_drive.sum(axis=0)
            d_e += d_drive @ w[f"in_{s}"].T
        g["embed"] = x.T @ (d_e * (1 - e * e))
        return g

    def fit(self, pages: list[tuple[list[Block], list[bool]]], epochs: int = 12, group: int = 48, rate: float = 0.015, seed: int = 11) -> Labeller:
        """Adam on the mean logistic loss of groups of pages of like length, in an order that the seed fixes."""
        r, m = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        slots = _WordSlots()
        dense = [(np.concatenate(list(vectors([page], slots))), np.array(label, np.float32)) for page, label in pages if page]
        order, step = np.argsort([len(x) for x, _ in dense], kind="stable"), 0
        groups = [order[i : i + group] for i in range(0, len(order), group)]
        for epoch in range(epochs):
            for k in r.permutation(len(groups)):
                some = [dense[i] for i in groups[k]]
                g = self._gradient(np.concatenate([x for x, _ in some]), np.array([len(x) for x, _ in some]), np.concatenate([y for _, y in some]))
                step += 1
                for name, d in g.items():
                    a, b = m[name]
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    self.w[name] = self.w[name] - np.float32(rate * 0.8**epoch) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
        return self


# Phrases of page furniture for the layouts.
FURNITURE = {
    "notice": ["We use cookies to improve this site.", "Accept", "Accept all cookies", "This site is not available in your region.", "Please enable JavaScript.", "Your trial ends soon."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Limited time only"],
    "share": ["Share", "Tweet", "Print", "Email this", "Follow us"],
    "form": ["Subscribe to our newsletter", "Your email", "Send", "Search", "Name", "Log in", "Password"],
    "comment": ["Comments", "3 comments", "Leave a reply", "Reply", "Posted by", "said", "Like"],
    "footer": ["&copy; 2024", "All rights reserved.", "Terms", "Privacy policy", "Contact", "Imprint"],
    "nav": ["Home", "About", "News", "Contact", "Products", "Blog", "Next", "Previous"],
}


class _Layouts:
    """Pages of random layout from given sentences. Main text is marked by a private character, which is taken off again."""

    MARK = ""

    def __init__(self, long: list[str], short: list[str], seed: int):
        self.r, self.long, self.short = random.Random(seed), long, short
        self.common = [w.lower() for kind in FURNITURE.values() for phrase in kind for w in phrase.split()]

    def some(self, low: int, high: int, make) -> str:
        return "".join(make() for _ in range(self.r.randint(low, high)))

    def words(self, kind: str) -> str:
        return self.r.choice(FURNITURE[kind]) if self.r.random() < 0.5 else self.r.choice(self.short)

    def box(self, inner: str, tags: str, names: str, plain: float = 0.15) -> str:
        tag, r = self.r.choice(tags.split()), self.r
        name = r.choice(names.split()) if tag in ("div", "section", "ul", "p", "span") else r.choice(["", "", *names.split()])
        if r.random() < plain:
            name = ""
        if name and r.random() < 0.4:
            name += r.choice(["-box", "-area", "-wrap", " block", " row", "-1", "s", "__inner"])
        if r.random() < 0.2:
            name = f"{name} {''.join(r.choice('abcdefghijklmnop') for _ in range(4))}".strip()
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def text(self) -> str:
        """A sentence; often with common words of furniture in it or of made-up words, so that no word tells main text by itself."""
        words, r = self.r.choice(self.long if self.r.random() < 0.6 else self.short).split(), self.r
        if r.random() < 0.5:
            share = r.random()
            words = [r.choice(self.common) if r.random() < share else w for w in words]
        if r.random() < 0.3:
            words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) if r.random() < 0.7 else w for w in words]
        return " ".join(words)

    def links(self, kind: str = "nav") -> str:
        item = lambda: f'<li><a href="/x">{self.words(kind)}</a></li>'
        return f"<ul>{self.some(2, 7, item)}</ul>" if self.r.random() < 0.7 else self.some(2, 6, lambda: f'<a href="/x">{self.words(kind)}</a> ')

    def nav(self) -> str:
        return self.box(self.links(), "nav nav div ul", "nav menu navbar navigation breadcrumb topnav", 0.3)

    def notice(self) -> str:
        return self.box(f"<p>{self.words('notice')} {self.text() if self.r.random() < 0.3 else ''}</p>" + ("<button>OK</button>" if self.r.random() < 0.5 else ""), "div section dialog", "cookie notice alert consent banner popup modal", 0)

    def ad(self) -> str:
        return self.box(self.r.choice([self.text(), self.words("ad"), f"<p>{self.words('ad')}</p><p>{self.text()}</p>", f'<a href="/x">{self.text()}</a>']), "div div aside section", "ad ads advert advertisement sponsored promo", 0)

    def sidebar(self) -> str:
        inner = f"<h3>{self.r.choice(self.short)}</h3>" + self.r.choice([self.links(), f"<p>{self.text()}</p>", self.some(1, 3, lambda: f'<p><a href="/x">{self.text()}</a></p>')])
        return self.box(inner, "aside aside div section", "sidebar widget related recommended aside", 0)

    def form(self) -> str:
        inner = f"<p>{self.words('form')}</p>" * self.r.randint(0, 1) + self.some(1, 3, lambda: f"<label>{self.words('form')}</label><input name=x>") + f"<button>{self.words('form')}</button>"
        return f"<form action=/x>{inner}</form>" if self.r.random() < 0.8 else self.box(inner, "div", "newsletter subscribe signup login search", 0)

    def share(self) -> str:
        return self.box(self.some(2, 4, lambda: f'<a href="/x">{self.r.choice(FURNITURE["share"])}</a> '), "div ul", "share social sharing", 0)

    def comments(self) -> str:
        one = lambda: self.box(f"<p>{self.r.choice(self.short)}</p><p>{self.text()}</p>" if self.r.random() < 0.6 else f"<p>{self.text()}</p>", "div li article", "comment reply comment-body", 0)
        return self.box(f"<h3>{self.words('comment')}</h3>" + self.some(1, 5, one) + (self.form() if self.r.random() < 0.3 else ""), "section div", "comments comment-list disqus replies", 0)

    def footer(self) -> str:
        return self.box(self.r.choice([f"{self.r.choice(FURNITURE['footer'])} {self.text()}", f"<p>{self.words('footer')}</p><p>{self.text()}</p>", self.links("footer")]), "footer footer div", "footer site-footer", 0)

    def header(self) -> str:
        return self.box(f"<{(t := self.r.choice(['div', 'p', 'h2', 'span']))}>{self.r.choice(self.short)}</{t}>" + (self.nav() if self.r.random() < 0.4 else ""), "header header div", "header masthead site-header", 0)

    def paragraph(self) -> str:
        r, text = self.r, self.MARK + self.text()
        kind = r.random()
        if kind < 0.6:
            return f"<p>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br>"
        if kind < 0.7:
            return f"<h2>{self.MARK}{r.choice(self.short)}</h2>"
        if kind < 0.78:
            return f"<ul>{self.some(1, 4, lambda: f'<li>{self.MARK}{self.text()}</li>')}</ul>"
        if kind < 0.84:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.88:
            return f"<table><tr>{self.some(1, 3, lambda: f'<td>{self.MARK}{self.r.choice(self.short)}</td>')}</tr></table>"
        if kind < 0.92:
            return f"<pre>{text}</pre>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{self.MARK}{r.choice(self.short)}</figcaption></figure>"
        return f'<p>{text} <a href="/x">{r.choice(self.short)}</a> {r.choice(self.short)}</p>'

    def article(self) -> str:
        r, parts = self.r, [self.paragraph() for _ in range(self.r.randint(1, 10))]
        for make in (self.ad, self.sidebar, self.share, self.form, self.notice):
            if r.random() < 0.2:
                parts.insert(r.randint(0, len(parts)), make())
        head = f"<h1>{self.MARK}{r.choice(self.short)}</h1>" if r.random() < 0.65 else ""
        inner = head + (self.box("".join(parts), "div section", "article-body entry-content text body", 0.3) if r.random() < 0.3 else "".join(parts))
        if r.random() < 0.25:
            inner += self.comments()
        inner = self.box(inner, "article article main div section", "content post entry article story main", 0.3)
        return f"<main>{inner}</main>" if r.random() < 0.2 else inner

    def page(self) -> tuple[list[Block], list[bool]]:
        r = self.r
        before = [f() for f, p in ((self.header, 0.5), (self.nav, 0.8), (self.notice, 0.3), (self.ad, 0.5), (self.sidebar, 0.25), (self.form, 0.2)) if r.random() < p]
        after = [f() for f, p in ((self.comments, 0.3), (self.share, 0.2), (self.sidebar, 0.3), (self.ad, 0.3), (self.nav, 0.2), (self.form, 0.2), (self.footer, 0.8), (self.notice, 0.2)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        before, after = [] if r.random() < 0.25 else before, [] if r.random() < 0.15 else after
        inner = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.4:
            inner = self.box(inner, "div", "page wrapper container site root layout", 0.2)
        page = blocks(f"<html><body>{inner}</body></html>")
        return [b._replace(text=b.text.replace(self.MARK, "")) for b in page if b.text != self.MARK], [self.MARK in b.text for b in page if b.text != self.MARK]


def layouts(pages: list[list[Block]], count: int = LAYOUTS, seed: int = 5) -> list[tuple[list[Block], list[bool]]]:
    """``count`` pages of random layout from the texts of ``pages``, with the labels of their blocks."""
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(_Layouts.MARK, "")
    texts = [b.text for p in pages for b in p] or ["Some words of a page, and more of them.", "A few words."]
    long = [escape(t) for t in texts if len(t) > 60] or ["Some words of a page, with more and more of them to read, one after another."]
    short = [escape(" ".join(t.split()[:6])) for t in texts] or ["A few words."]
    make = _Layouts(long, short, seed)
    return [make.page() for _ in range(count)]


def fit_labeller(pages: DataFrame, size: int = SAMPLE) -> Labeller:
    """A labeller fitted on the ``size`` distinct rows of ``pages(page_id, html)`` with the smallest hashes and on layouts made of them."""
    key = {"_h": F.xxhash64("page_id", "html")}
    there = pages.where("html IS NOT NULL").select("page_id", "html").withColumns(key)
    chosen = there.select("_h").distinct().orderBy("_h").limit(size)  # numbers only: the pages themselves are fetched after
    rows = there.join(F.broadcast(chosen), "_h").dropDuplicates(["_h"]).orderBy("_h").select("page_id", "html").collect()
    given = []
    for row in rows:
        page = blocks(row["html"])
        at = zlib.crc32(str(row["page_id"]).encode()) % max(1, len(page) - SPAN + 1)
        if page:
            given.append(page[at : at + SPAN])
    known = [(p, [b.label for b in p]) for p in given if any(b.label for b in p)]
    return Labeller().fit(known + layouts(given))


_BLOCKS = "array<struct<text string, tag string, score double, main boolean>>"


def _label(model: Labeller, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "html", 8_000_000):
            pages = [blocks(h) if h else [] for h in shard["html"].to_pylist()]
            score, at, values = model.scores(pages), 0, []
            for page in pages:
                of = score[at : at + len(page)]
                at += len(page)
                if whole:
                    values.append([{"text": b.text, "tag": b.tag, "score": float(s), "main": bool(s >= 0.5)} for b, s in zip(page, of, strict=True)])
                else:
                    values.append("\n".join(b.text for b, s in zip(page, of, strict=True) if s >= 0.5))
            kind = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("score", pa.float64()), ("main", pa.bool_())])) if whole else pa.string()
            yield pa.RecordBatch.from_arrays([shard["page_id"], shard["url"], pa.array(values, kind)], ["page_id", "url", "blocks" if whole else "text"])
    return run


def label_blocks(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, blocks): the blocks of each row of ``pages(page_id, url, html)`` with the element they lie in, their score and label."""
    return pages.select("page_id", "url", "html").mapInArrow(_label(model, True), f"page_id {dict(pages.dtypes)['page_id']}, url string, blocks {_BLOCKS}")


def extract_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text): the main text of each row of ``pages(page_id, url, html)``, a line for each block."""
    return pages.select("page_id", "url", "html").mapInArrow(_label(model, False), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")
