"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks. Each block is a vector of its hashed tag path (names, classes, identifiers), its hashed
words and a few figures; a bidirectional LSTM reads all blocks of the page in order and labels each as main text or not,
so that every label depends on the whole document. The network is trained here, in numpy, on pages made by rule.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PATHS, WORDS, WIDTH, HIDDEN, FIGURES = 1024, 2048, 12, 16, 4
#: Blocks of padded pages labelled at once.
BATCH = 8192

#: HTML's elements that have no end tag, that hold no text to read, that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas math".split())
#: Those of RAW that only an end tag or the page's end closes.
SCRIPTS = frozenset(("script", "style"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open one of their kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+|[^>]*)>|<[!?][^>]*>|[^<]+|<", re.DOTALL)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+")
ENDS = re.compile(r"[\s\"']")


def _closed(given: str) -> bool:
    """Whether a tag's attributes end in a slash that is not part of a bare value."""
    return given.endswith("/") and "=" not in ENDS.split(given)[-1]


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, names on the path to it, characters in links) of each leaf block, in page order."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, path = 0, ()

    def flush() -> None:
        nonlocal text, linked
        if text:
            if joined := " ".join(html.unescape("".join(text)).split()):
                out.append((joined, path, linked))
            text, linked = [], 0

    here, unclosed = 0, set()
    while here < len(page):
        m = TOKENS.match(page, here)
        here, name = m.end(), m[2]
        if name is None:
            if (s := m[0])[0] != "<" or s == "<":
                if not text:
                    path = tuple(n for _, names in stack for n in names)
                text.append(s)
                if any(t == "a" for t, _ in stack):
                    linked += len(s)
            continue
        name = name.lower()
        if name in RAW and not m[1]:
            if name in SCRIPTS or not (_closed(m[3]) or name in unclosed):
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, here)
                if end:
                    here = end.end()
                elif name in SCRIPTS:
                    break
                else:
                    unclosed.add(name)  # nor is any after it, and what follows is the page's
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    if any(t not in INLINE for t, _ in stack[at:]):
                        flush()
                    del stack[at:]
                    break
        elif name not in VOID:
            if name not in INLINE:  # a new block ends an open paragraph
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == "p":
                        del stack[at:]
                    if at >= len(stack) or stack[at][0] not in INLINE:
                        break
            if name in CLOSES:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] in CLOSES[name]:
                        del stack[at:]
                        break
                    if stack[at][0] not in INLINE and stack[at][0] not in CLOSES[name]:
                        break
            given = [p for g in NAMES.findall(m[3]) for p in PARTS.findall("".join(g).lower())]
            stack.append((name, (name, *(f".{p}" for p in given))))
    flush()
    return out


@functools.lru_cache(100_000)
def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


def features(found: list) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Hashed path names, hashed words and figures of each block."""
    paths = [[_bucket(n, PATHS) for n in p] + [_bucket(f"leaf {next((n for n in reversed(p) if n[0] != '.'), '')}", PATHS)] for _, p, _ in found]
    words = [[_bucket(w, WORDS) for w in t.lower().split()] for t, _, _ in found]
    figures = np.array([[np.log1p(len(t)) / 6, k / max(1, len(t)), len(w) / (10 + len(w)), t[-1] in ".!?"] for (t, _, k), w in zip(found, words, strict=True)], np.float32)
    return paths, words, figures


class Labeller:
    """Embeddings of path names and words, an LSTM for each direction, and a logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        size = 2 * WIDTH + FIGURES
        self.w = {"path": r.normal(0, 0.3, (PATHS, WIDTH)), "word": r.normal(0, 0.1, (WORDS, WIDTH)), "out": r.normal(0, 0.3, 2 * HIDDEN + size), "bias": np.zeros(1)}
        for d in "fb":
            self.w[f"x{d}"], self.w[f"h{d}"], self.w[f"b{d}"] = r.normal(0, 0.3, (size, 4 * HIDDEN)), r.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)
            self.w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def _mean(table: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        length = np.array([len(i) for i in ids])
        flat = np.fromiter((x for i in ids for x in i), np.int64, length.sum())
        start = np.cumsum(length) - length
        total = np.add.reduceat(table[flat], np.minimum(start, len(flat) - 1)) if len(flat) else np.zeros((len(ids), table.shape[1]), table.dtype)
        return np.where(length[:, None] > 0, total / np.maximum(length, 1)[:, None], 0)

    def _inputs(self, x) -> np.ndarray:
        paths, words, figures = x
        return np.concatenate([self._mean(self.w["path"], paths), self._mean(self.w["word"], words), figures], 1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str):
        """x (time, page, input) -> hidden states, and what the way back needs."""
        steps, pages, _ = x.shape
        wh, gates = self.w[f"h{d}"], x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ wh
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            kept.append((t, i, f, o, g, c, th, h, m))
            c, h = np.where(m, new, c), np.where(m, o * th, h)
            out[t] = h
        return out, kept

    def _back(self, x: np.ndarray, kept: list, grad: np.ndarray, d: str, g_w: dict) -> np.ndarray:
        """Gradient of the inputs, by backpropagation through time."""
        pages = x.shape[1]
        dh, dc, dx = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros_like(x)
        wx, wh = self.w[f"x{d}"], self.w[f"h{d}"]
        for t, i, f, o, g, c, th, h, m in reversed(kept):
            dh = dh + grad[t]
            a, e = dh * m, dc * m
            do, dn = a * th, e + a * o * (1 - th * th)
            dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g * g)], 1)
            g_w[f"x{d}"] += x[t].T @ dz
            g_w[f"h{d}"] += h.T @ dz
            g_w[f"b{d}"] += dz.sum(0)
            dx[t] = dz @ wx.T
            dh, dc = dz @ wh.T + dh * ~m, dn * f + dc * ~m
        return dx

    def _padded(self, pages: list) -> tuple[np.ndarray, np.ndarray, list]:
        length = [len(p[0]) for p in pages]
        x, mask = np.zeros((max(length), len(pages), 2 * WIDTH + FIGURES), np.float32), np.zeros((max(length), len(pages)), bool)
        for k, p in enumerate(pages):
            x[: length[k], k], mask[: length[k], k] = self._inputs(p), True
        return x, mask, length

    def probabilities(self, pages: list) -> list[np.ndarray]:
        """Of each block of each page (features) to be main text. Pages without blocks are not allowed."""
        out: list = [None] * len(pages)
        order, at = sorted(range(len(pages)), key=lambda k: len(pages[k][0])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]][0]) <= BATCH:
                end += 1
            x, mask, length = self._padded([pages[k] for k in order[at:end]])
            z = np.concatenate([self._pass(x, mask, "f")[0], self._pass(x, mask, "b")[0], x], 2) @ self.w["out"] + self.w["bias"]
            for j, k in enumerate(order[at:end]):
                out[k] = 1 / (1 + np.exp(-z[: length[j], j]))
            at = end
        return out

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int = 9, rate: float = 0.012, seed: int = 3) -> None:
        """Adam on the blocks' log loss, in batches of 32 pages."""
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        r, step = random.Random(seed), 0
        for epoch in range(epochs):
            rate *= 1 if epoch < epochs // 2 else 0.5
            order = list(range(len(pages)))
            r.shuffle(order)
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                x, mask, length = self._padded([pages[k] for k in some])
                (hf, kf), (hb, kb) = self._pass(x, mask, "f"), self._pass(x, mask, "b")
                all_ = np.concatenate([hf, hb, x], 2)
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(some):
                    y[: length[j], j] = labels[k]
                dz = (1 / (1 + np.exp(-(all_ @ self.w["out"] + self.w["bias"]))) - y) * mask / mask.sum()
                g = {k: np.zeros_like(v) for k, v in self.w.items()}
                g["out"], g["bias"] = np.tensordot(dz, all_, ([0, 1], [0, 1])).astype(np.float32), np.array([dz.sum()], np.float32)
                da = (dz[:, :, None] * self.w["out"]).astype(np.float32)
                dx = da[:, :, 2 * HIDDEN :] + self._back(x, kf, da[:, :, :HIDDEN], "f", g) + self._back(x, kb, da[:, :, HIDDEN : 2 * HIDDEN], "b", g)
                for j, k in enumerate(some):
                    for which, ids, a in (("path", pages[k][0], 0), ("word", pages[k][1], WIDTH)):
                        n = np.array([len(i) for i in ids])
                        flat = np.fromiter((v for i in ids for v in i), np.int64, n.sum())
                        np.add.at(g[which], flat, np.repeat(dx[: length[j], j, a : a + WIDTH] / np.maximum(n, 1)[:, None], n, axis=0))
                step += 1
                for k, v in self.w.items():
                    m, s = moment[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    v *= 1 - (rate * 0.1 if k == "word" else 0)  # words are many and most say little
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


#: Marks main text in the training pages; taken out before a network sees them.
MARK = "\ue000"


def training_page(r: random.Random) -> str:
    """A page made by rule, its main text marked: an article among menus, headers, sidebars, notices, adverts, forms,
    comments and footers, in any of several ways of writing each."""
    letters = "".join(r.sample("abcdefghijklmnoprstuvwyzéüñ", 14))
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=3, b=25: words(a, b).capitalize() + r.choice([".", ".", ".", "", "!"])
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6])))
    name = lambda *n: r.choice(["class", "id"]) + '="' + r.choice([*n]) + '"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n))

    def boiler(kind: str) -> str:
        if kind == "nav":
            return r.choice([f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f"<div {name('menu', 'navbar', 'nav', 'breadcrumb')}><ul>{links(5)}</ul></div>", f"<nav>{''.join(f'<a href=/>{word()}</a> ' for _ in range(5))}</nav>"])
        if kind == "header":
            return r.choice([f"<header><h1>{words(1, 3)}</h1><p>{sentence()}</p></header>", f"<div {name('header', 'masthead', 'topbar', 'site-header')}><h2>{words(1, 3)}</h2>{sentence()}</div>", f"<header><a href=/>{word()}</a></header>"])
        if kind == "ad":
            return f"<div {name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{r.choice([sentence(), '<p>' + prose() + '</p>'])}</div>"
        if kind == "notice":
            return r.choice([f"<div {name('cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup')}><p>{prose()}</p><button>{word()}</button></div>", f'<div role="dialog"><p>We use cookies. {prose()}</p></div>'])
        if kind == "aside":
            return r.choice([f"<aside><h3>{words(1, 4)}</h3><p>{prose()}</p></aside>", f"<aside><ul>{links(4)}</ul></aside>", f"<div {name('sidebar', 'related', 'widget', 'share', 'social', 'recommended')}><h4>{words(1, 3)}</h4><ul>{links(3)}</ul><p>{prose()}</p></div>"])
        if kind == "form":
            return f"<form action=/><label>{words(1, 3)}</label><input name=q><p>{sentence()}</p><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>"
        if kind == "comments":
            one = lambda: r.choice([f'<li class="comment"><p>{prose()}</p></li>', f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>', f"<article class=comment><p>{prose()}</p></article>"])
            return f"<{(t := r.choice(['div', 'section', 'ol']))} {name('comments', 'comment-list', 'discussion', 'replies')}><h3>{words(1, 2)}</h3>{''.join(one() for _ in range(r.randint(1, 5)))}</{t}>"
        return r.choice([f"<footer>&copy; {word()}.example.com &middot; {prose()}</footer>", f"<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>", f"<div {name('footer', 'copyright', 'site-footer', 'legal')}><p>&copy; {r.randint(1990, 2030)} {prose()}</p></div>"])

    def main() -> str:
        out = [f"<h1>{MARK}{words(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            out.append(r.choice([
                f"<p>{MARK}{prose()}</p>", f"<p>{MARK}{prose()}</p>", f"<p>{MARK}{prose()}</p>", f"<p>{MARK}{word()}.</p>", f"<p><b>{MARK}{prose()}<br>", f"<p>{MARK}{prose()} <a href=/>{words(1, 3)}</a> {prose()}</p>",
                f"<h2>{MARK}{words(1, 6)}</h2>", f"<ul><li>{MARK}{sentence()}</li><li>{MARK}{sentence()}</li></ul>", f"<blockquote>{MARK}{prose()}</blockquote>", f"<pre>{MARK}{words(3, 30)}</pre>",
                f"<table><tr><td>{MARK}{word()}</td><td>{MARK}{word()}</td></tr></table>", f"<div>{MARK}{prose()}</div>", f"<figure><figcaption>{MARK}{sentence()}</figcaption></figure>",
            ]))
        if r.random() < 0.25:
            out.insert(r.randint(0, len(out)), boiler(r.choice(["ad", "aside", "notice", "form"])))
        if not any(MARK in x for x in out):
            out.append(f"<p>{MARK}{prose()}</p>")
        inner = "".join(out)
        return r.choice([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f"<div {name('content', 'post', 'entry-content', 'article-body', 'story', 'main')}>{inner}</div>", f"<section {name('content', 'article')}>{inner}</section>"])

    before = [boiler(k) for k in ("notice", "header", "nav", "ad", "aside", "form") if r.random() < 0.45]
    after = [boiler(k) for k in ("aside", "ad", "form", "comments", "nav", "notice") if r.random() < 0.35]
    foot = [boiler("footer")] if r.random() < 0.85 else []
    r.shuffle(before)
    return f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{main()}{''.join(after + foot)}</body></html>"


@functools.cache
def trained(pages: int = 1600, seed: int = 11) -> Labeller:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        found = blocks(training_page(r))
        ys.append(np.array([MARK in t for t, _, _ in found], np.float32))
        xs.append(features([(t.replace(MARK, "") or "-", p, k) for t, p, k in found]))
    out = Labeller()
    out.fit(xs, ys)
    return out


def main_text(pages: list[str | None], labeller: Labeller) -> list[str]:
    """Main text of each page: its main blocks, joined by blank lines."""
    found = [blocks(p or "") for p in pages]
    some = [k for k, f in enumerate(found) if f]
    out = [""] * len(pages)
    if some:
        for k, p in zip(some, labeller.probabilities([features(found[k]) for k in some]), strict=True):
            out[k] = "\n\n".join(t for (t, _, _), y in zip(found[k], p, strict=True) if y >= 0.5)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null, empty and textless pages give an empty text. Repeated rows and null identifiers are rows like any other; an
    empty table gives an empty result; extra columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(trained())  # a network of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            text = main_text([h if isinstance(h, str) else None for h in x["html"]], shared.value)
            yield pd.DataFrame({"page_id": x["page_id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
