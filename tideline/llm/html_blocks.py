"""HTML extraction: a recurrent labeller over a page's sequence of text blocks.

A page is read once into blocks: runs of text between block-level tags, with the path of
open elements (tag names, words of class, id and role). Scripts, styles and other elements
without prose are passed over, character references are decoded, white space becomes one
space. Every block becomes a vector of hashed path, hashed words and a few measures; a
bidirectional LSTM (numpy) reads the whole sequence and labels each block main text or not.

Training needs no labels by hand: ``SAMPLE`` pages of at most ``FIT_CHARS`` characters (those of
the smallest hashes among the pages that mark their article with <article> or <main>; bounds on
the fit only) give them, less what such pages mark as something else. Where no page of the
table marks its article, the blocks that lie in no element of ``ASIDE`` stand in for it. Copies of
these pages with renamed wrappers and with menus, notices, adverts, forms, sidebars and comments of
the page's own words set in between teach the labeller layouts that the sample lacks. All
pages are labelled by the network alone.

Tags are read as browsers read them: quotes count after an equals sign only, end tags of paragraphs and
list items may lack, what has no end tag swallows no text. Reading takes time that grows with a
page's length only; of open elements, a block's path tells the ``DEPTH`` outermost.

Results: one row per row; text is empty for null or empty html and where no block is main
text. Pages of any length are read whole. page_id may be null or repeated; equal pages get equal
texts; a block whose probability ties at one half is kept. An empty table gives an empty
result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

#: Element names, and names that authors give to parts of a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe"}  # up to their end tag, or to the page's end
SKIPPED = {"noscript", "template", "object", "svg", "math", "canvas", "select", "datalist"}  # up to their end tag, if there is one
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "copyright", "disqus",
    "footer", "form", "header", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "replies",
    "reply", "search", "share", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
MAIN_WRAPPERS = ["article", "main", "main article", "div.post", "div.content", "div.entry content", "section.article body", "div.post body", "div.story", "div.main text"]
ASIDE_WRAPPERS = [
    "nav ul li a", "header div", "footer p", "aside div", "aside section.widget p", "form label", "form div", "div.sidebar div", "div.menu ul li a", "ul.nav li a",
    "div.ad", "div.ads banner", "div.advert", "div.sponsored", "div.promo", "div.cookie notice", "div.cookie banner p", "div.consent p", "div.notice", "div.popup",
    "div.newsletter signup form p", "div.subscribe", "div.share", "div.social links a", "div.related ul li a", "section.comments div.comment p", "div.comments p",
    "ol.comments li.comment p", "div.comment body", "div.reply", "div.breadcrumb a", "div.copyright", "div.login", "div.search form", "div.site header", "div.site footer p", "div.page header",
]

MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Attributes of a tag that is written as it should be; others are read one by one.
PLAIN = re.compile(r"((?:\s+[a-zA-Z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`/]+))?)*)\s*(/?)>")
BEFORE = re.compile(r"(?:[\s/]+|[^\s/>=]+(?=[\s/>])(?!\s*=))*")  # white space, and attributes without a value
NAME, EQUALS, BARE = re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
NAMES = re.compile(r"(?<![^\s])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

DEPTH = 512  # open elements that a block's path tells; browsers nest no deeper either
SAMPLE, EPOCHS, HIDDEN = 150, 10, 16
STEPS = 375  # of the fit at least, however few pages there are
FIT_CHARS = 200_000
MARKED = r"(?i)<(article|main)[\s>]"
PATH, WORD, MEASURES = 64, 32, 6
WIDTH = PATH + WORD + MEASURES


@lru_cache(maxsize=20000)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple(w for m in NAMES.finditer(attributes) for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w)


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]
    text: str
    linked: float = 0.0


class _Page:
    """A page's characters, and where each mark that may be missing comes last: nothing is looked for in vain twice."""

    def __init__(self, html: str):
        self.html, self.last = html, {c: html.rfind(c) for c in (">", '"', "'", "-->", "]]>")}
        low = html.lower()
        # lower case of a few letters is longer
        self.low = low if len(low) == len(html) else "".join(c.lower() if c.isascii() else c for c in html)
        self.ends: dict[str, int] = {}

    def find(self, mark: str, at: int) -> int:
        """The next ``mark``, or -1."""
        return self.html.find(mark, at) if at <= self.last[mark] else -1

    def past_end_tag(self, tag: str, at: int) -> int:
        """Where the next end tag of ``tag`` ends, or -1."""
        if tag not in self.ends:
            self.ends[tag] = self.low.rfind(f"</{tag}")
        if at > self.ends[tag]:
            return -1
        close = self.find(">", self.low.find(f"</{tag}", at))
        return close + 1 if close >= 0 else len(self.html)

    def attributes(self, at: int) -> tuple[str, bool, int]:
        """Attributes of a tag from ``at``, whether it closes itself, and where it ends. Quotes count after an
        equals sign only; a quote without a partner ends with the tag. A tag without an end is the rest of the page."""
        m = PLAIN.match(self.html, at)
        if m:
            return m[1], bool(m[2]), m.end()
        found: list[str] = []
        while True:
            at = BEFORE.match(self.html, at).end()
            close = self.find(">", at)
            if close < 0:
                return "", False, len(self.html)
            if self.html[at] == ">":
                return " " + " ".join(found), self.html[at - 1] == "/", at + 1
            m = NAME.match(self.html, at)
            name, at = m[0], m.end()
            m = EQUALS.match(self.html, at)
            if not m:
                continue
            at = m.end()
            quote = self.html[at : at + 1]
            if quote in ('"', "'") and quote:
                past = self.find(quote, at + 1)
                past = close if past < 0 else past
                value, at = self.html[at + 1 : past], past + (self.html[past] == quote)
            else:
                m = BARE.match(self.html, at)
                value, at = m[0], m.end()
            if name.lower() in ("class", "id", "role"):
                found.append(name + '="' + value.replace('"', " ") + '"')


def blocks(html: str | None) -> list[Block]:
    """The page's text blocks in order; any string is accepted, in time that grows with its length."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    open_: Counter = Counter()  # of the stack's tags
    run: list[str] = []
    path: tuple = ()
    linked, spoken = 0, False

    def end() -> None:
        nonlocal linked, spoken
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(Block(path, text, min(1.0, linked / len(text))))
        run.clear()
        linked, spoken = 0, False

    def say(text: str) -> None:
        nonlocal path, linked, spoken
        if text.strip():
            if not spoken:
                path, spoken = tuple(stack[:DEPTH]), True
            if open_["a"]:
                linked += len(text)
        run.append(text)

    def close_from(k: int) -> None:
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]

    html = html or ""
    page, at = _Page(html), 0
    while (m := MARKUP.search(html, at)) is not None:
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = TAG.match(html, at)
        if tag is None:  # a comment, a declaration, or what browsers take for one
            kind = "-->" if html.startswith("!--", at) else "]]>" if html.startswith("![CDATA[", at) else ">"
            past = page.find(kind, at + 1)
            if kind == "]]>" and past >= 0:
                say(entities.escape(html[at + 8 : past]))
            elif kind == "]]>":
                kind, past = ">", page.find(">", at)
            at = past + len(kind) if past >= 0 else len(html)
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        told, alone, at = page.attributes(tag.end())
        if not closing and not alone and (name in RAW or name in SKIPPED):
            past = page.past_end_tag(name, at)
            if past >= 0 or name in RAW:
                at = past if past >= 0 else len(html)
            continue
        if name not in INLINE:
            end()
        elif name == "br":
            run.append(" ")
        if closing:
            k = len(stack) - 1 if open_[name] else -1
            while k >= 0 and stack[k][0] != name and (name not in INLINE or stack[k][0] in INLINE):
                k -= 1
            if k >= 0 and stack[k][0] == name:
                close_from(k)
            continue
        if name not in INLINE:  # an open paragraph or item ends here
            ended = CLOSES.get(name, set()) | {"p"}
            if any(open_[x] for x in ended):
                k = len(stack)
                while k and (stack[k - 1][0] in INLINE or stack[k - 1][0] in ended):
                    k -= 1
                first = next((i for i in range(k, len(stack)) if stack[i][0] in ended), None)
                if first is not None:
                    close_from(first)
        if name not in VOID and not alone:
            stack.append((name, *_names(told)) if told.strip() else (name,))
            open_[name] += 1
    if at < len(html):
        say(html[at:])
    end()
    return out


def is_aside(path: tuple[tuple[str, ...], ...]) -> bool:
    return any(x[0] in ASIDE or any(w in ASIDE_NAMES for w in x[1:]) for x in path)


def is_main(path: tuple[tuple[str, ...], ...]) -> bool:
    return any(x[0] in ("article", "main") for x in path) and not is_aside(path)


@lru_cache(maxsize=50000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    out = np.zeros(PATH)
    for element in path:
        for k, word in enumerate(element):
            h = zlib.crc32(f"{'.' if k else ''}{word}".encode())
            out[h % PATH] += 1.0 if h & 0x10000 else -1.0
            h = zlib.crc32(f"{word}{'.' if k else ''}!".encode())
            out[h % PATH] += 1.0 if h & 0x10000 else -1.0
    return np.tanh(out)


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """(blocks, WIDTH) for each page."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), WIDTH), np.float32)
    row = 0
    for _, data, offsets in textops.chunks(pa.array([b.text for b in flat], pa.string())):
        w, first = textops.words(data, offsets)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        bins = np.bincount(doc * WORD + (w >> np.uint64(59)).astype(np.int64), minlength=len(n) * WORD).reshape(-1, WORD)
        part = x[row : row + len(n)]
        part[:, PATH : PATH + WORD] = np.sqrt(bins / np.maximum(n, 1)[:, None])
        part[:, PATH + WORD] = np.log1p(n) / 4
        row += len(n)
    row = 0
    for page in pages:
        size = sum(len(b.text) for b in page) or 1
        before = 0
        for k, b in enumerate(page):
            x[row, :PATH] = _path_vector(b.path)
            x[row, PATH + WORD + 1 :] = b.linked, len(b.text) / size, before / size, 1.0 if k == 0 else 0.0, 1.0 if b.text[-1] in ".!?" else 0.0
            before += len(b.text)
            row += 1
    at = np.cumsum([0, *map(len, pages)])
    return [x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per step."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.p = {f"{d}{n}": r.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (("w", 0.15, (width, 4 * hidden)), ("u", 0.15, (hidden, 4 * hidden)), ("c", 0.0, (4 * hidden,)))}
        for d in "fb":
            self.p[f"{d}c"][hidden : 2 * hidden] = 1  # remember at first
        self.p["o"] = r.normal(0, 0.2, (2 * hidden,)).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)
        self.h = hidden

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states (steps, pages, hidden) in one direction; x: (steps, pages, width)."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, self.h), np.float32)
        out = np.zeros((steps, pages, self.h), np.float32)
        trace = []
        z_in = x @ self.p[f"{d}w"] + self.p[f"{d}c"]
        k = self.h
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"{d}u"]
            s = _sigmoid(np.concatenate([z[:, : 2 * k], z[:, 3 * k :]], 1))
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(z[:, 2 * k : 3 * k])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out, trace

    def probabilities(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._scan(x, mask, "f", keep)
        b, tb = self._scan(x, mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"][0]), both, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, tf, tb = self.probabilities(x, mask, True)
        delta = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.tensordot(delta, both, ((0, 1), (0, 1)))
        g["ob"][0] = delta.sum()
        d_both = delta[..., None] * self.p["o"]
        k = self.h
        for d, trace, d_out in (("f", tf, d_both[..., :k]), ("b", tb, d_both[..., k:])):
            dh = dc = np.zeros((x.shape[1], k), np.float32)
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            for t, h0, c0, i, f, o, a, tc, m in reversed(trace):
                dh = dh + d_out[t]
                do, dct = dh * tc, dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dct * a * i * (1 - i), dct * c0 * f * (1 - f), dct * i * (1 - a * a), do * o * (1 - o)], 1)
                dz = np.where(m, dz, 0)
                dz_all[t] = dz
                g[f"{d}u"] += h0.T @ dz
                dh, dc = np.where(m, dz @ self.p[f"{d}u"].T, dh), np.where(m, dct * f, dc)
            g[f"{d}w"] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            g[f"{d}c"] = dz_all.sum((0, 1))
        return g

    def fit(self, x: list[np.ndarray], y: list[np.ndarray], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01) -> None:
        """Adam over batches of pages of similar length."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        r = np.random.default_rng(1)
        order = sorted(range(len(x)), key=lambda k: len(x[k]))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        step = 0
        for _ in range(epochs):
            for k in r.permutation(len(groups)):
                px, mask = padded([x[i] for i in groups[k]])
                py = padded([y[i][:, None] for i in groups[k]])[0][..., 0]
                step += 1
                for name, g in self.gradients(px, mask, py).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= (rate * m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, x: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """For each page which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(x)
        order = sorted((k for k in range(len(x)) if len(x[k])), key=lambda k: len(x[k]))
        at = 0
        while at < len(order):
            size = max(1, min(batch, 40_000 // max(1, len(x[order[min(at + batch, len(order)) - 1]]))))
            group = order[at : at + size]
            p = self.probabilities(*padded([x[k] for k in group]))[0]
            for j, k in enumerate(group):
                out[k] = p[: len(x[k]), j] >= 0.5
            at += size
        return out


def padded(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, width) and which of them are blocks."""
    steps = max(map(len, x))
    out = np.zeros((steps, len(x), x[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(x)), bool)
    for j, rows in enumerate(x):
        out[: len(rows), j] = rows
        mask[: len(rows), j] = True
    return out, mask


def _wrapper(text: str) -> tuple[tuple[str, ...], ...]:
    """``div.post body p``: names after a dot belong to its element until the next tag name."""
    out: list[tuple[str, ...]] = []
    tags = INLINE | ASIDE | {"ul", "ol", "li", "p", "div", "section", "article", "main"}
    for word in text.split():
        tag, _, name = word.partition(".")
        if out and tag not in tags:
            out[-1] += (tag,)
        else:
            out.append((tag, name) if name else (tag,))
    return tuple(out)


def varied(page: list[Block], r: np.random.Generator, chosen: Callable = is_main) -> tuple[list[Block], list[bool]]:
    """A copy with another wrapper around the main text (``chosen``) and other parts set in between."""
    main = _wrapper(str(r.choice(MAIN_WRAPPERS)))
    top = page[0].path[:2] if len(page[0].path) > 2 and page[0].path[0][0] == "html" else (("html",), ("body",))
    words = [w for b in page for w in b.text.split()] or ["-"]
    out: list[Block] = []
    y: list[bool] = []

    def other(inside: bool) -> None:
        path = top + (main if inside else ()) + _wrapper(str(r.choice(ASIDE_WRAPPERS)))
        for _ in range(int(r.integers(1, 7))):
            at, n = int(r.integers(len(words))), int(r.integers(1, 12 if r.random() < 0.6 else 60))
            text = " ".join(words[at : at + n])
            out.append(Block(path, text, 1.0 if path[-1][0] == "a" else 0.0))
            y.append(False)

    for _ in range(int(r.integers(0, 4))):
        other(False)
    for b in page:
        if chosen(b.path):
            tail = tuple(x for x in b.path if x[0] in ("p", "h1", "h2", "h3", "li", "blockquote", "ul", "b", "i")) or (("p",),)
            out.append(Block(top + main + tail, b.text, b.linked))
            y.append(True)
            if r.random() < 0.06:
                other(True)
    if r.random() < 0.4:
        other(True)
    for _ in range(int(r.integers(0, 4))):
        other(False)
    return out, y


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller | None:
    """A labeller from a bounded sample of pages; none where no page has a block."""
    rows = pages.where(r"html rlike '\\S'").select("html", F.xxhash64("html").alias("h"), F.length("html").alias("n"))
    short, plain = rows.where(f"n <= {FIT_CHARS}"), lambda path: not is_aside(path)
    # pages with marks; else any pages; a few of the long ones where there are no others
    for some, chosen, bound in ((short.where(F.col("html").rlike(MARKED)), is_main, sample), (short, plain, sample), (rows, plain, 5)):
        top = some.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
        if top is None:
            continue
        texts = some.where(F.col("h") <= top).select("html").distinct().collect()  # ``bound`` pages
        read = [b for b in map(blocks, sorted(r["html"] for r in texts)) if any(chosen(x.path) for x in b)]
        if read:
            break
    else:
        return None
    r = np.random.default_rng(9)
    x, y = list(read), [[chosen(b.path) for b in p] for p in read]
    for page in read:
        for _ in range(3):
            made, told = varied(page, r, chosen)
            x.append(made)
            y.append(told)
    labeller = Labeller()
    labeller.fit(vectors(x), [np.array(t, np.float32) for t in y], epochs=max(EPOCHS, STEPS * 16 // len(x)))
    return labeller


def _extract(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = model.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                read = [blocks(h) for h in part.column(2).to_pylist()]
                keep = labeller.label(vectors(read)) if labeller else [np.zeros(len(p), bool) for p in read]
                texts = [" ".join(b.text for b, k in zip(p, kept, strict=True) if k) for p, kept in zip(read, keep, strict=True)]
                n = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
