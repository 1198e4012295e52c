"""Main text of web pages: a linear-chain conditional random field over the blocks of a page.

A page is cut into leaf blocks, the runs of text between block-level tags. A block's features come from its ancestors'
tags, their class, id and role words, and its text. The field's weights are trained by gradient ascent on labelled
pages (`training_pages` makes them from varied layouts), and a page's labels are decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

#: Where something other than text begins, and what a comment, a declaration or a bogus tag is. No pattern goes back over what it has read, so a page takes time in proportion to its length.
_MARK = re.compile(r"<(?=[!?/a-zA-Z])")
_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_SPLIT = re.compile(r"[^a-z]+")

#: Elements without text of the page. Those of the first kind hold no markup: only their own end tag ends them.
RAW_TEXT = {"script", "style", "noscript", "iframe", "textarea", "title"}
RAW = RAW_TEXT | {"template", "canvas", "select", "datalist", "annotation", "desc", "metadata"}
#: Any other start tag ends a head that is still open.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"}
_SCRIPT_PARTS = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag of the first kind ends an open element of the second, as HTML's optional end tags have it.
_CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "button", "legend", "summary", "html", "body"}
_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP_AT = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

GOOD_WORDS = {"article", "content", "main", "post", "entry", "body", "story", "text", "blog"}
#: Groups of words in class, id or role that speak for boilerplate.
BAD_WORDS = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "toolbar", "pagination", "pager", "skip", "toc"},
    "edge": {"header", "masthead", "banner", "footer", "foot", "copyright", "colophon", "top", "bottom", "site", "legal"},
    "side": {"sidebar", "aside", "side", "widget", "related", "recommended", "trending", "popular", "complementary", "rail", "teaser", "more", "promo", "tags", "meta", "author", "byline", "share", "social"},
    "note": {"cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "signup", "login", "paywall", "disclaimer"},
    "ad": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "banner", "promotion"},
    "talk": {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "review", "reviews", "commentlist"},
    "form": {"form", "search", "searchbox", "contact"},
}
_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "li", "p", "h1", "h2", "h3", "a", "button", "dialog", "blockquote", "pre", "figure", "fieldset", "label", "menu", "td", "dl", "div", "details", "address")
_NAMES = [
    "bias", *(f"tag_{t}" for t in _TAGS), *(f"own_{t}" for t in ("p", "li", "div", "td", "h", "a", "body", "span")), "good", *(f"bad_{k}" for k in BAD_WORDS), "no_bad", "in_main", "in_main_bad",
    "len_0", "len_1", "len_2", "len_3", "len_4", "link_none", "link_some", "link_most", "ended", "copyright", "hidden", "first", "last", "deep",
]
_INDEX = {n: i for i, n in enumerate(_NAMES)}
_DROP_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "header"}


@lru_cache(maxsize=None)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)


def _next_mark(page: str, at: int) -> tuple[int, int, re.Match | None]:
    """(start, end, tag) of the next markup from `at` on: a tag, or a comment, declaration, CDATA section or bogus tag as None."""
    m = _MARK.search(page, at)
    if m is None:
        return len(page), len(page), None
    start = m.start()
    if page.startswith("<!--", start):
        if page.startswith((">", "->"), start + 4):
            return start, page.index(">", start) + 1, None
        end = _COMMENT_END.search(page, start + 4)
        return start, end.end() if end else len(page), None
    if page.startswith("<![CDATA[", start):
        end = page.find("]]>", start)
        return start, end + 3 if end >= 0 else len(page), None
    tag = _TAG.match(page, start)
    if tag:
        return start, tag.end(), tag
    if page[start + 1] in "!?/" and not page[start + 2 : start + 3].isalpha() or page[start + 1] in "!?":
        end = page.find(">", start)
        return start, end + 1 if end >= 0 else len(page), None
    return start, len(page), None  # a tag that the page's end cuts


class _RawText:
    """Where a page goes on after raw-text elements."""

    def __init__(self, page: str):
        self.page = page
        self.endless: set[str] = set()  # elements that no end tag is left for
        self.plain = False  # a script's comment reached the page's end before, so scripts end at their first end tag

    def closed(self, name: str, at: int) -> re.Match | None:
        if name in self.endless:
            return None
        m = _end_tag(name).search(self.page, at)
        if m is None:
            self.endless.add(name)
        return m

    def after(self, name: str, at: int) -> int:
        """The place after the end tag of the raw-text element whose content starts at `at`; the page's end if there is none.

        A script in a script's comment keeps its own end tag, as HTML has it, if another one follows.
        """
        first = self.closed(name, at)
        if first is None:
            return len(self.page)
        if name == "script" and not self.plain:
            commented, inner, pos = False, False, at
            while m := _SCRIPT_PARTS.search(self.page, pos):
                pos = m.end()
                if m[0] == "<!--":
                    commented, pos = True, m.start() + 2  # its dashes may be those of the comment's end
                elif m[0] == "-->":
                    commented = inner = False
                elif not m[1]:
                    inner = commented
                elif inner:
                    inner = False
                else:
                    return _end_tag(name).match(self.page, m.start()).end()
            self.plain = True
        return first.end()


@lru_cache(maxsize=4096)
def _of_short(tag: str, attrs: str) -> frozenset:
    return _of_element(tag, attrs)


def _of_element(tag: str, attrs: str) -> frozenset:
    """Names of the features that an element gives to all blocks inside."""
    out = {f"tag_{tag}"} if tag in _TAGS else set()
    if attrs:
        low = attrs.lower()
        words: set[str] = set()
        for name, *values in _ATTR.findall(low):
            value = next((v for v in values if v), "")
            if name in ("class", "id", "role", "data-component", "itemprop", "aria-label", "data-role"):
                words.update(_SPLIT.split(value))
            if (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true"):
                out.add("hidden")
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", low):
            out.add("hidden")
        if tag not in ("html", "body"):
            if words & GOOD_WORDS:
                out.add("good")
            out |= {f"bad_{k}" for k, group in BAD_WORDS.items() if words & group}
            if words & {"main", "article"} or "articlebody" in words:
                out.add("in_main")
    if tag in ("article", "main"):
        out.add("in_main")
    return frozenset(out)


def blocks_of(page: str) -> list[tuple[str, frozenset, str, float, int]]:
    """(text, ancestor features, innermost block tag, share of linked characters, depth) of a page's leaf blocks, in page order.

    Scripts, styles, comments and the head give none. Character references are decoded and white space is one space. A tag that the page's end cuts, and what a comment without an end holds, are no text, as in HTML.
    """
    out = []
    stack: list[tuple[str, frozenset, str]] = []  # tag, features so far, innermost block
    opened: dict[str, list[int]] = {}  # where the open elements of a tag stand in the stack
    parts: list[str] = []
    linked = 0
    raw_until = None
    in_head = False
    raw = _RawText(page)
    at = 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            size = len(text)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, stack[-1][1] if stack else frozenset(), stack[-1][2] if stack else "body", linked / size, len(stack)))
            parts.clear()
        linked = 0

    def close_from(i: int):
        for t, _, _ in stack[i:]:
            opened[t].pop()
        del stack[i:]

    def innermost(tags: set) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def close(ends: set, stop: set):
        """Close the innermost open element of `ends` unless one of `stop` is inside of it."""
        i = innermost(ends)
        if i >= 0 and i > innermost(stop - ends):
            close_from(i)

    while at < len(page):
        start, end, m = _next_mark(page, at)
        if raw_until is None and start > at:
            piece = page[at:start]
            in_head = in_head and not piece.strip()
            if not in_head:
                parts.append(piece)
                if opened.get("a"):
                    linked += len(piece)
        at = end
        if m is None:
            if raw_until is None and not in_head and page.startswith("<![CDATA[", start):
                inside = page[start + 9 : end]
                parts.append(html.escape(inside.removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if raw_until is not None:
            if m[1] and tag == raw_until:
                raw_until = None
            elif not m[1] and tag in RAW_TEXT and not m[3].endswith("/"):
                at = raw.after(tag, at)
            continue
        if in_head:
            in_head = tag not in ("head", "body", "html", "br") if m[1] else tag in IN_HEAD
            if in_head and tag not in RAW:
                continue
        if m[1]:  # an end tag
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                close_from(opened[tag][-1])
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                if tag in RAW_TEXT:
                    at = raw.after(tag, at)
                elif raw.closed(tag, at):
                    raw_until = tag
            continue
        if tag == "head":
            in_head = True
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                close({"p"}, BLOCK)
            elif tag in _ENDS:
                close(_ENDS[tag], _STOP_AT[tag])
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        attrs = m[3].strip()
        own = _of_short(tag, attrs) if len(attrs) < 500 else _of_element(tag, attrs)
        above, block = stack[-1][1:] if stack else (frozenset(), "body")
        stack.append((tag, above | own if own - above else above, tag if tag in BLOCK else block))
        opened.setdefault(tag, []).append(len(stack) - 1)
    flush()
    return out


@lru_cache(maxsize=65536)
def _features(above: frozenset, own: str, length: int, link: str, flags: tuple) -> tuple[int, ...]:
    names = [n for n in above if n in _INDEX]
    bad = any(n.startswith("bad_") for n in above) or any(f"tag_{t}" in above for t in _DROP_TAGS)
    names += ["bias", f"len_{length}", link, "own_h" if own in ("h1", "h2", "h3", "h4", "h5", "h6") else f"own_{own}" if f"own_{own}" in _INDEX else "own_span", *flags]
    if not bad:
        names.append("no_bad")
    elif "in_main" in above:
        names.append("in_main_bad")
    return tuple(sorted({_INDEX[n] for n in names}))


def block_features(blocks: list) -> list[tuple[int, ...]]:
    """Indices of the binary features of each block."""
    out = []
    for i, (text, above, own, link, depth) in enumerate(blocks):
        flags = []
        if text[-1] in ".!?:;\"'”»…":
            flags.append("ended")
        head = text[:40].lower()
        if text[0] == "©" or "copyright" in head or len(text) < 400 and "all rights reserved" in text.lower():
            flags.append("copyright")
        if i == 0:
            flags.append("first")
        if i == len(blocks) - 1:
            flags.append("last")
        if depth > 8:
            flags.append("deep")
        out.append(_features(above, own, len(text) // 40 if len(text) < 120 else 3 + (len(text) > 300), "link_none" if link < 0.1 else "link_some" if link < 0.6 else "link_most", tuple(flags)))
    return out


class Field:
    """Two labels (0 boilerplate, 1 article): weights of features by label, and of label pairs."""

    def __init__(self):
        self.w = np.zeros((len(_NAMES), 2))
        self.pair = np.zeros((2, 2))
        self.known: dict[tuple[int, ...], tuple[float, float]] = {}

    def emissions(self, features: list[tuple[int, ...]]) -> list[tuple[float, float]]:
        for f in set(features) - self.known.keys():
            self.known[f] = tuple(self.w[list(f)].sum(axis=0).tolist())
        return [self.known[f] for f in features]

    def viterbi(self, features: list[tuple[int, ...]]) -> list[int]:
        e = self.emissions(features)
        (p00, p01), (p10, p11) = self.pair.tolist()
        (a, b), back = e[0], []
        for x, y in e[1:]:
            from0, from1 = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = x + (a + p00 if from0 else b + p10), y + (a + p01 if from1 else b + p11)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def step(self, features: list[tuple[int, ...]], labels: list[int], rate: float, l2: float) -> None:
        """One gradient step of the conditional log-likelihood of a page."""
        self.known.clear()  # the weights change
        e = np.array(self.emissions(features))
        n = len(e)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = e[0]
        for i in range(1, n):
            alpha[i] = e[i] + np.logaddexp(alpha[i - 1, 0] + self.pair[0], alpha[i - 1, 1] + self.pair[1])
        for i in range(n - 2, -1, -1):
            t = self.pair + e[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(t[:, 0], t[:, 1])
        z = np.logaddexp(*alpha[-1])
        marginal = np.exp(alpha + beta - z)
        self.w *= 1 - rate * l2
        for i, f in enumerate(features):
            g = -marginal[i]
            g[labels[i]] += 1
            self.w[list(f)] += rate * g
        if n > 1:
            joint = np.exp(alpha[:-1, :, None] + self.pair + (e + beta)[1:, None, :] - z).sum(axis=0)
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            self.pair += rate * (seen - joint)


def training_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Labelled pages of varied layouts. Article text is marked by words that begin with 'x', boilerplate by 'z'."""
    rng = random.Random(seed)

    def words(lead: str, low: int, high: int, end: str = ".") -> str:
        return " ".join(lead + "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(rng.randint(low, high))) + end

    def link(lead: str, k: int = 2) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(lead, 1, k, "")}</a>'

    def links(k: int) -> str:
        kind = rng.choice(("ul", "div", "plain"))
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{link('z')}</li>" for _ in range(k)) + "</ul>"
        if kind == "div":
            return "".join(f"<div>{link('z', 4)}</div>" for _ in range(k))
        return " | ".join(link("z") for _ in range(k))

    def wrapped(tag: str, names: tuple, inside: str) -> str:
        return _wrap(rng, tag, names, inside)

    def boiler() -> str:
        k = rng.randrange(10)
        if k == 0:
            return wrapped("nav", ("nav", "menu", "main-menu", "navbar", "breadcrumbs"), links(rng.randint(3, 8)))
        if k == 1:
            return wrapped("aside", ("sidebar", "related-posts", "widget", "side"), f"<h3>{words('z', 1, 4, '')}</h3>" + links(rng.randint(2, 5)) + (f"<p>{words('z', 8, 40)}</p>" if rng.random() < 0.5 else ""))
        if k == 2:
            return wrapped("", ("ad", "ads", "advert", "ad-banner", "sponsored"), words("z", 4, 20) if rng.random() < 0.6 else f"<p>{words('z', 6, 30)}</p>")
        if k == 3:
            return wrapped("form", ("search-form", "contact", "newsletter", "signup"), f"<label>{words('z', 1, 4, ':')}</label><input name=q><button>{words('z', 1, 2, '')}</button><p>{words('z', 5, 20)}</p>")
        if k == 4:
            return wrapped("", ("cookie-notice", "notice", "consent", "gdpr-banner", "alert", "popup"), f"<p>{words('z', 8, 40)}</p><button>{words('z', 1, 2, '')}</button>")
        if k == 5:
            return wrapped("header", ("header", "masthead", "site-header", "top-bar"), f"<div>{words('z', 1, 4, '')}</div>" + (f"<p>{words('z', 3, 12)}</p>" if rng.random() < 0.5 else links(3)))
        if k == 6:
            return wrapped("", ("share", "social", "tags", "byline", "post-meta"), links(3))
        if k == 7:
            return wrapped("dialog", ("modal", "overlay", "paywall", "subscribe"), f"<h2>{words('z', 2, 5, '')}</h2><p>{words('z', 8, 30)}</p>")
        if k == 8:
            return f'<div style="display:none">{words("z", 5, 30)}</div>'
        return wrapped("", ("promo", "teaser", "trending", "popular"), f"<h4>{words('z', 2, 6, '')}</h4><p>{words('z', 8, 25)}</p>")

    def comments() -> str:
        rows = "".join(f'<{rng.choice(("li", "div"))} class="{rng.choice(("comment", "reply", "comment-body"))}"><b>{words("z", 1, 2, "")}</b><p>{words("z", 4, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
        return _wrap(rng, "", ("comments", "comment-list", "discussion", "responses comments", "reviews"), f"<h3>{words('z', 1, 3, '')}</h3>{rows}")

    def article() -> str:
        out = [f"<h1>{words('x', 2, 12, rng.choice(('', '.')))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            k = rng.random()
            if k < 0.68:
                body = words("x", 1, 120)
                if rng.random() < 0.25:
                    body += " " + link("x", 3) + " " + words("x", 2, 20)
                if rng.random() < 0.2:
                    body = f"<b>{body}<br>" if rng.random() < 0.5 else f"<em>{body}</em>"
                out.append(rng.choice((f"<p>{body}</p>", f"<p>{body}", f"<div>{body}</div>")))
            elif k < 0.78:
                out.append(f"<h2>{words('x', 1, 6, '')}</h2>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{words('x', 2, 25, rng.choice(('', '.')))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.91:
                out.append(f"<blockquote>{words('x', 5, 40)}</blockquote>")
            elif k < 0.95:
                out.append(f"<table><tr><td>{words('x', 1, 5, '')}</td><td>{words('x', 1, 5, '')}</td></tr></table>")
            elif k < 0.97:
                out.append(f"<pre>{words('x', 3, 20, '')}</pre>")
            else:
                out.append(boiler())
        return "".join(out)

    pages = []
    for _ in range(n):
        body = [boiler() for _ in range(rng.randint(0, 4))]
        kind = rng.randrange(5)
        inside = article() + (comments() if rng.random() < 0.15 else "")
        if kind == 0:
            body.append(f"<article>{inside}</article>")
        elif kind == 1:
            body.append(f"<main>{inside}</main>")
        elif kind == 2:
            body.append(f'<main class="page"><article class="post">{inside}</article></main>')
        elif kind == 3:
            body.append(f'<div {rng.choice(("class", "id"))}="{rng.choice(("content", "post-content", "entry", "article-body", "story", "main"))}">{inside}</div>')
        else:
            body.append(f"<div><div>{inside}</div></div>")
        if rng.random() < 0.4:
            body.append(comments())
        body += [boiler() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.8:
            body.append(_wrap(rng, "footer", ("footer", "site-footer", "copyright", "colophon"), f"&copy; {words('z', 2, 20)}" if rng.random() < 0.7 else links(4)))
        pages.append(f"<!DOCTYPE html><html><head><title>z</title></head><body>{''.join(body)}</body></html>")
    return pages


def _wrap(rng: random.Random, tag: str, names: tuple, inside: str) -> str:
    name = f'{rng.choice(("class", "id"))}="{rng.choice(names)}"'
    if tag and rng.random() < 0.6:
        return f"<{tag}{' ' + name if rng.random() < 0.4 else ''}>{inside}</{tag}>"
    box = rng.choice(("div", "div", "section"))
    return f"<{box} {name}>{inside}</{box}>"


@lru_cache(maxsize=1)
def trained_field(pages: int = 240, epochs: int = 6) -> Field:
    """The field fitted on `training_pages`; the same in every process."""
    data = []
    for page in training_pages(pages):
        blocks = blocks_of(page)
        if blocks:
            data.append((block_features(blocks), [int(b[0].lstrip("© ")[:1] == "x") for b in blocks]))
    field, order = Field(), random.Random(5)
    for epoch in range(epochs):
        order.shuffle(data)
        for features, labels in data:
            field.step(features, labels, 0.1 / (1 + epoch), 1e-4)
    field.known.clear()
    return field


def main_text(page: str | None, field: Field) -> str:
    """The article's blocks joined by one space; empty for an empty page or one without an article."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    labels = field.viterbi(block_features(blocks))
    return " ".join(b[0] for b, y in zip(blocks, labels) if y)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of `pages`.

    A null or empty html gives an empty text; broken markup is read as far as it goes. Repeated rows are read alike.
    """
    small_batches(spark)
    field = trained_field()
    kept = pages.select("page_id", "url").schema

    def run(batches):
        for batch in batches:
            texts = [main_text(h, field) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "text string", "n_chars long"])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, read(spark, sf_dir, "pages"))
