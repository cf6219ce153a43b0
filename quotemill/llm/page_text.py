"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks (runs of text between block-level tags) with the tags, classes and ids of their ancestors. Two labels, article
or not; the features of a block are its ancestors and what its text looks like, the chain carries how labels follow each other.
The field is trained on labelled pages by maximum likelihood (forward-backward, all pages at once) and decoded by Viterbi in a map over the pages.

The labelled pages are made here by rule: layouts as the web has them, each block known to be article or not, with invented words, so that
nothing is learned from a page's words. Training is deterministic, takes a bounded number of pages and happens once on the driver.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never text of the page (of the first kind it reaches to the end tag whatever stands between, of the second to
# the end of the parent at most), inline elements, and elements without an end tag.
RAW = "script|style|noscript|template|textarea|title|iframe"
HIDDEN = frozenset("svg select object math canvas audio video".split())
#: Drawings and formulas end before an opening tag of these, unless one of the second kind is open in them.
FOREIGN = frozenset("svg math".split())
LEAVES = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu nobr ol p pre ruby table ul".split())
HOLDS = frozenset("foreignobject desc annotation-xml mtext mi mo mn ms".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: An element that holds this share of a page's text, or half of it with a main heading or main part inside, is a wrapper.
WRAPS_TEXT, WRAPS_HEADED = 0.9, 0.5


def _marked(found: list[tuple[str, tuple[int, ...], float]], elements: list[tuple[str, tuple[str, ...]]], headed: set[int]) -> list[tuple[str, tuple[str, ...], float]]:
    """Blocks with the marks of their ancestors: tags, and the words of their names. Words of what wraps the page's main part (its body, or an element
    that holds most of the text) are set apart by ``~``: they speak of the page, not of this part of it."""
    held = [0] * len(elements)
    for text, chain, _ in found:
        for e in chain:
            held[e] += len(text)
    total = sum(len(text) for text, _, _ in found)
    marks = []
    for e, (tag, words) in enumerate(elements):
        wraps = tag in ("html", "body") or held[e] >= WRAPS_TEXT * total or (e in headed and held[e] >= WRAPS_HEADED * total)
        marks.append(("<" + tag, *(("~" + w for w in words) if wraps else words)))
    return [(text, tuple(m for e in chain for m in marks[e]), linked) for text, chain, linked in found]


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """Leaf blocks of a page in order: text (references decoded, white space as one blank, trimmed), marks of its ancestors, share of
    characters inside links. Missing end tags, stray end tags and broken markup are tolerated."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    elements: list[tuple[str, tuple[str, ...]]] = []
    headed: set[int] = set()
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    inner: list[str] = []  # elements open from a hidden one on
    linked = in_link = 0

    def end_block():
        nonlocal linked
        raw = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append((text, tuple(e for _, e in stack), min(1.0, linked / max(1, len(raw)))))
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        text = page[at : m.start()]
        if text and not inner:
            parts.append(text)
            if in_link:
                linked += len(text)
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not inner:
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        closed = attributes.endswith("/")
        if inner:
            if closing:
                if tag in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                    continue
                if tag not in INLINE and all(tag != t for t, _ in stack):
                    continue
                inner.clear()  # the end of what the hidden element stands in
            elif inner[0] in FOREIGN and tag in LEAVES and HOLDS.isdisjoint(inner):
                inner.clear()
            else:
                if tag not in VOID and not (closed and not FOREIGN.isdisjoint([*inner, tag])):
                    inner.append(tag)
                continue
        elif tag in HIDDEN and not closing:
            if not (closed and tag in FOREIGN):
                inner.append(tag)
            continue
        elif tag in HIDDEN:
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                end_block()
            continue
        end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            in_link = 0
        elif not closed:
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
                stack.pop()
            if tag in ("h1", "main"):
                headed.update(e for _, e in stack)
            words = [w.lower() for names in NAMES.findall(attributes) for w in PART.findall("".join(names))]
            stack.append((tag, len(elements)))
            elements.append((tag, tuple(words)))
    if page[at:] and not inner:
        parts.append(page[at:])
    end_block()
    return _marked(out, elements, headed)


def features(found: list[tuple[str, tuple[str, ...], float]]) -> list[list[str]]:
    """Names of the features each block has."""
    out = []
    n = len(found)
    for k, (text, marks, linked) in enumerate(found):
        words = text.count(" ") + 1
        own = next((m for m in reversed(marks) if m[0] == "<"), "<none")
        got = {"wrap:" + m[1:] if m[0] == "~" else "in:" + m for m in marks}
        got |= {"own:" + own, f"words:{min(6, words.bit_length())}", f"links:{int(linked * 4)}"}
        got.add("stop" if text[-1] in ".!?…\"'”»。" else "open")
        got |= {f"sign:{c}" for c in "©|»·" if c in text}
        got |= {"first"} if k == 0 else set()
        got |= {"last"} if k == n - 1 else set()
        out.append(sorted(got))
    return out


@dataclass(frozen=True)
class Field:
    """Weights per feature and label, and per pair of following labels. Names of wrappers have none of their own."""

    emit: dict[str, float]
    follow: tuple[tuple[float, float], tuple[float, float]]
    bias: float

    def label(self, found) -> list[int]:
        """Most probable labels of a page's blocks (Viterbi). Only differences between the two labels matter for emissions."""
        if not found:
            return []
        emit = self.emit
        # a wrapper's name may say that the page has main text, never that this is none of it
        weight = lambda f: max(0.0, emit.get("in:" + f[5:], 0.0)) if f.startswith("wrap:") else emit.get(f, 0.0)
        score = [sum(map(weight, fs)) + self.bias for fs in features(found)]
        (a, b), (c, d) = self.follow
        zero, one = 0.0, score[0]
        back = []
        for s in score[1:]:
            to_zero, to_one = (zero + a, one + c), (zero + b, one + d)
            back.append((to_zero[1] > to_zero[0], to_one[1] > to_one[0]))
            zero, one = max(to_zero), max(to_one) + s
        at = int(one > zero)
        labels = [at]
        for step in reversed(back):
            at = int(step[at])
            labels.append(at)
        return labels[::-1]


def train(pages: list[tuple[list, list[int]]], rounds: int = 800, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Maximum likelihood on labelled pages: lists of blocks with lists of labels. All chains advance together, padded."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in fs if not f.startswith("wrap:")] for fs in features(found)] for found, _ in pages]
    s, t = len(rows), max(len(r) for r in rows)
    flat = np.array([f for r in rows for fs in r for f in fs])
    block = np.array([i * t + j for i, r in enumerate(rows) for j, fs in enumerate(r) for _ in fs])
    live = np.zeros((s, t), dtype=bool)
    gold = np.zeros((s, t), dtype=int)
    for i, (_, labels) in enumerate(pages):
        live[i, : len(labels)] = True
        gold[i, : len(labels)] = labels
    pair_live = live[:, 1:]
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (gold[:, :-1][pair_live], gold[:, 1:][pair_live]), 1)
    w, bias, follow = np.zeros(len(names)), 0.0, np.zeros((2, 2))
    seen_w, seen_b, seen_f = np.full(len(names), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    total = live.sum()
    for _ in range(rounds):
        score = np.zeros((s, t, 2))
        score[..., 1] = np.bincount(block, weights=w[flat], minlength=s * t).reshape(s, t) + bias
        ahead = np.zeros((s, t, 2))
        ahead[:, 0] = score[:, 0]
        for k in range(1, t):
            step = np.logaddexp(ahead[:, k - 1, 0, None] + follow[0], ahead[:, k - 1, 1, None] + follow[1]) + score[:, k]
            ahead[:, k] = np.where(live[:, k, None], step, ahead[:, k - 1])
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        after = np.zeros((s, t, 2))
        for k in range(t - 2, -1, -1):
            nxt = score[:, k + 1] + after[:, k + 1]
            step = np.logaddexp(follow[:, 0] + nxt[:, 0, None], follow[:, 1] + nxt[:, 1, None])
            after[:, k] = np.where(live[:, k + 1, None], step, 0.0)
        chance = np.exp(ahead + after - norm[:, None, None])[..., 1] * live
        pairs = ahead[:, :-1, :, None] + follow + (score + after)[:, 1:, None, :] - norm[:, None, None, None]
        expected = (np.exp(pairs) * pair_live[..., None, None]).sum(axis=(0, 1))
        error = ((gold - chance) * live).reshape(-1)
        grad_w = np.bincount(flat, weights=error[block], minlength=len(names)) / total - ridge * w
        grad_b, grad_f = error.sum() / total, (wanted - expected) / total - ridge * follow
        seen_w += grad_w**2
        seen_b += grad_b**2
        seen_f += grad_f**2
        w += rate * grad_w / np.sqrt(seen_w)
        bias += rate * grad_b / np.sqrt(seen_b)
        follow += rate * grad_f / np.sqrt(seen_f)
    return Field({n: float(w[i]) for n, i in names.items()}, tuple(map(tuple, follow.tolist())), float(bias))


# Illustrative layouts: what wraps an article, and what surrounds it.
WRAPS = (
    ("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"), ("<div class='content'>", "</div>"), ("<main>", "</main>"),
    ("<div id='main-content'><div class='entry-content'>", "</div></div>"), ("<div class='story-body'>", "</div>"), ("<section class='article-body'>", "</section>"),
    ("<div class='post-text'>", "</div>"), ("<article itemprop='articleBody'>", "</article>"),
)
AROUND = {
    "menu": ("<nav><ul>{links}</ul></nav>", "<div class='menu'>{links_plain}</div>", "<ul class='navbar nav'>{links}</ul>", "<nav class='breadcrumb'>{links_plain}</nav>", "<div role='navigation'>{links_plain}</div>"),
    "header": ("<header><div class='logo'>{short}</div><p>{short}</p></header>", "<div id='header'><h2>{short}</h2></div>", "<div class='site-header top'>{links_plain}{short}</div>", "<header>{short}</header>"),
    "footer": ("<footer>&copy; {short} &middot; {sentence}</footer>", "<div id='footer'><p>© {short}</p><p>{sentence}</p></div>", "<footer><p>{sentence}</p><ul>{links}</ul></footer>", "<div class='copyright'>{sentence}</div>"),
    "sidebar": ("<aside><h3>{short}</h3><p>{sentence}</p><ul>{links}</ul></aside>", "<div class='sidebar'><p>{sentences}</p></div>", "<div class='related'><h3>{short}</h3>{links_plain}</div>", "<aside>{sentences}</aside>", "<div class='widget recommended'>{links_plain}<p>{sentence}</p></div>"),
    "notice": ("<div class='cookie-notice'>{sentence}<button>{short}</button></div>", "<div id='cookie-banner'><p>{sentences}</p></div>", "<div class='notice alert'>{sentence}</div>", "<div class='newsletter subscribe'><p>{sentence}</p></div>", "<div role='dialog' class='consent popup'><p>{sentence}</p></div>"),
    "advert": ("<div class='ad'>{sentence}</div>", "<div class='advert'><a href='/x'>{sentence}</a></div>", "<div id='ads-banner'><p>{sentences}</p></div>", "<div class='sponsored promo'><p>{sentence}</p></div>", "<ins class='adsbygoogle'></ins><div class='advertisement'>{sentence}</div>"),
    "form": ("<form><label>{short}</label><input type='text'><button>{short}</button></form>", "<form class='search'><p>{sentence}</p><input></form>", "<form action='/s'><fieldset><legend>{short}</legend>{sentence}</fieldset></form>"),
    "comments": ("<div class='comments'><h3>{short}</h3><div class='comment'><p>{sentences}</p></div><div class='comment'><p>{sentence}</p></div></div>", "<section id='comments'><ol class='comment-list'><li><p>{sentences}</p></li></ol></section>", "<ul class='replies'><li class='reply'>{sentences}</li></ul>", "<div id='disqus_thread' class='discussion'><p>{sentences}</p></div>"),
    "share": ("<div class='share social'>{links_plain}</div>", "<ul class='tags'>{links}</ul>", "<div class='pagination pager'>{links_plain}</div>"),
}


def labelled_pages(n: int = 500, seed: int = 7) -> list[tuple[list, list[int]]]:
    """Pages with known labels: a mark in the text of each block tells it, and is taken out before features are made."""
    rnd = random.Random(seed)

    def word():
        return "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8)))

    def sentence(low=5, high=18):
        return " ".join(word() for _ in range(rnd.randint(low, high))).capitalize() + "."

    def fill(pattern, mark):
        links = [f"<a href='/{word()}'>{mark}{word()}</a>" for _ in range(rnd.randint(3, 7))]
        return pattern.format(
            links="".join(f"<li>{x}</li>" for x in links), links_plain=" ".join(links), short=mark + " ".join(word() for _ in range(rnd.randint(1, 4))).title(),
            sentence=mark + sentence(), sentences=mark + " ".join(sentence() for _ in range(rnd.randint(2, 5))),
        )

    def body():
        yield f"<h1>\x01{sentence(3, 10)[:-1]}</h1>"
        if rnd.random() < 0.3:
            yield f"<p><b>\x01{sentence()}<br>"
        for _ in range(rnd.randint(3, 14)):
            kind = rnd.random()
            text = "\x01" + " ".join(sentence(1, 30) for _ in range(rnd.choice((1, 1, 2, 4, 8))))
            if kind < 0.72:
                yield f"<p>{text}" + rnd.choice(("</p>", "</p>", ""))
            elif kind < 0.8:
                yield "<ul>" + "".join(f"<li>\x01{sentence(2, 9)}</li>" for _ in range(3)) + "</ul>"
            elif kind < 0.88:
                yield f"<h2>\x01{sentence(2, 7)[:-1]}</h2>"
            elif kind < 0.93:
                yield f"<blockquote>{text}</blockquote>"
            elif kind < 0.97:
                yield f"<p>\x01<a href='/{word()}'>{sentence()}</a></p>"
            else:
                yield f"<table><tr><td>\x01{word()}</td><td>\x01{word()}</td></tr></table>"

    out = []
    for _ in range(n):
        before = [k for k in ("menu", "header", "notice", "advert", "form", "share") if rnd.random() < 0.5]
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rnd.random() < 0.45]
        inner = [k for k in ("advert", "share", "sidebar", "comments", "notice", "form") if rnd.random() < 0.15]
        rnd.shuffle(before)
        start, end = rnd.choice(WRAPS)
        parts = list(body())
        for k in inner:
            parts.insert(rnd.randint(1, len(parts)), fill(rnd.choice(AROUND[k]), "\x02"))
        around = lambda kinds: "".join(fill(rnd.choice(AROUND[k]), "\x02") for k in kinds)
        page = f"<html><head><title>x</title></head><body>{around(before)}{start}{''.join(parts)}{end}{around(after)}</body></html>"
        found, labels = [], []
        for text, marks, linked in blocks(page):
            labels.append(int("\x01" in text))
            found.append((text.replace("\x01", "").replace("\x02", "") or "x", marks, linked))
        out.append((found, labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return " ".join(text for (text, _, _), keep in zip(found, field.label(found), strict=True) if keep)


def extract(pages: DataFrame, *columns: str, field: Field | None = None, html_col: str = "html") -> DataFrame:
    """The given columns of every row, ``text`` (main text; empty if the page has none, or its html is null or empty) and ``n_chars``.

    Pages are read whole; rows with null or repeated ids are kept; other columns are not read.
    """
    field = field or default_field()
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, field) for p in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"]
            )

    return pages.select(*[F.col(c) for c in columns], F.coalesce(F.col(html_col), F.lit("")).alias("_html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
