"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block becomes a vector: its tag path
with classes and ids, hashed; its words, hashed; some shape numbers.  A
bidirectional LSTM in numpy reads the whole sequence, so every block is
classified with the document before and after it, and the blocks taken for
content are joined.

The labeller is trained on a bounded sample of the pages (``SAMPLE_PAGES``).
Labels come from the markup where it speaks plainly; the same pages are also
rebuilt from their own texts with other markup, other boilerplate around the
article and less telling names, so that the net has to learn from context too.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.words import sampled

SAMPLE_PAGES, REBUILT_PAGES = 300, 1500
#: Longer pages are labelled like all others, but none is sent to the driver for the fit.
SAMPLE_CHARS = 100_000
HIDDEN, EPOCHS, WINDOW = 16, 8, 48
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 96, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS

# ── blocks ───────────────────────────────────────────────────────────────────

_RAW = "script|style|template|iframe|title|textarea"
#: A tag's name ends at white space, a slash or the tag's end; quotes count only after an equals sign.
_ENDED = r"(?=[\s/>])"
_ATTRIBUTES = r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+"
#: Tags that end a drawing without a closing tag, as in a browser.
_BREAKS_OUT = (
    "address|article|aside|b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|fieldset|footer|form|h[1-6]|head|header|hr|html"
    "|i|img|li|main|menu|meta|nav|ol|p|pre|ruby|s|section|small|span|strong|strike|sub|sup|table|td|th|tr|tt|u|ul|var"
)
_DRAWING = rf"<svg{_ENDED}{_ATTRIBUTES}(?:(?<=/)>|(?<!/)>.*?(?:</svg\s*>|(?=</?(?:{_BREAKS_OUT})[\s/>])|\Z))"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW}){_ENDED}{_ATTRIBUTES}>.*?(?:</\1{_ENDED}[^>]*>|\Z)|{_DRAWING}|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})/?>|[^<]+|<",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: A formula is part of its sentence.
_INLINE |= set(
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_PARAGRAPH = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text between block-level tags."""
    out: list[Block] = []
    names: list[str] = []
    path: list[str] = []
    text: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        got = " ".join(entities.unescape("".join(text)).split())
        if got:
            out.append(Block(tuple(path), got, linked))
        text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        name = m.group(3)
        if name is None:
            piece = m.group(0)
            if m.group(1) is None and (piece[0] != "<" or piece == "<"):
                text.append(piece)
                linked += len(piece) * in_link
            continue
        name, closing = name.lower(), m.group(2) == "/"
        if name in _INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                in_link = not closing
            continue
        flush()
        in_link = False
        if closing:
            if name in names:
                at = len(names) - 1 - names[::-1].index(name)
                del names[at:], path[at:]
            continue
        shut = _CLOSES.get(name, {"p"} if name in _ENDS_PARAGRAPH else ())
        while names and names[-1] in shut:
            names.pop(), path.pop()
        if name not in _VOID:
            named = name
            for key, *values in _ATTRIBUTE.findall(m.group(4)):
                named += " " + {"class": ".", "id": "#", "role": "@"}[key.lower()] + "".join(values).lower()
            names.append(name)
            path.append(named)
    flush()
    return out


# ── vectors ──────────────────────────────────────────────────────────────────

_PART = re.compile(r"[a-z]+")
_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        got = np.zeros(PATH_DIMS, np.float32)
        for depth, element in enumerate(path):
            tag, _, rest = element.partition(" ")
            marks = ["tag " + tag, *("name " + p for p in _PART.findall(rest))]
            if depth >= len(path) - 2:
                marks.append("near " + tag)
            for mark in marks:
                h = zlib.crc32(mark.encode())
                got[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
        got = np.clip(got, -2, 2)
        if len(_paths) < 20_000:
            _paths[path] = got
    return got


def vectors(leaves: list[Block]) -> np.ndarray:
    out = np.zeros((len(leaves), DIMS), np.float32)
    for i, b in enumerate(leaves):
        out[i, :PATH_DIMS] = _path_vector(b.path)
        words = b.text.lower().split()
        marks = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        counts = np.bincount(marks % WORD_DIMS, minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(1 + float(counts @ counts))
        n, tail = len(b.text), b.text[-1:]
        out[i, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(len(words)) / 4, np.log1p(n) / 8, b.linked / n, tail in ".!?", "©" in b.text, len(words) < 4,
            i / len(leaves), min(1.0, len(leaves) / 50),
        )
    return out


# ── the net ──────────────────────────────────────────────────────────────────


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over (time, batch, dims); padding must come last."""

    def __init__(self, rng: np.random.Generator, dims: int, hidden: int):
        self.w = (rng.standard_normal((dims, 4 * hidden)) / np.sqrt(dims)).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, keep: bool = False):
        steps, batch, _ = x.shape
        k = self.u.shape[0]
        h, c = np.zeros((batch, k), np.float32), np.zeros((batch, k), np.float32)
        drive = x @ self.w + self.b
        out, saved = np.zeros((steps, batch, k), np.float32), []
        for t in range(steps):
            z = drive[t] + h @ self.u
            gates = _sigmoid(z[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
            before, was = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep:
                saved.append((i, f, o, g, s, was, before))
        return out, saved

    def backward(self, x: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
        k = self.u.shape[0]
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(saved) - 1, -1, -1):
            i, f, o, g, s, was, before = saved[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * was * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dw += x[t].T @ dz
            du += before.T @ dz
            db += dz.sum(axis=0)
            dh, dc = dz @ self.u.T, dc * f
        return [dw, du, db]


def _flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every sequence backwards, padding left at the end."""
    out = x.copy()
    for j, n in enumerate(lengths):
        out[:n, j] = x[:n, j][::-1]
    return out


class Labeller:
    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.there, self.back = Lstm(rng, DIMS, hidden), Lstm(rng, DIMS, hidden)
        self.v = (rng.standard_normal(2 * hidden + DIMS) * 0.05).astype(np.float32)
        self.a = np.zeros(1, np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.there.w, self.there.u, self.there.b, self.back.w, self.back.u, self.back.b, self.v, self.a]

    def _score(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        flipped = _flipped(x, lengths)
        one, saved_one = self.there.forward(x, keep)
        two, saved_two = self.back.forward(flipped, keep)
        joined = np.concatenate([one, _flipped(two, lengths), x], axis=2)
        return _sigmoid(joined @ self.v + self.a), joined, flipped, saved_one, saved_two

    def content(self, sequences: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """Probability of being content for the blocks of every sequence."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        while order:
            # the longest left and as many others as keep the padded size small
            longest = len(sequences[order[-1]])
            size = max(1, min(batch, 20_000 // longest))
            part, order = order[-size:], order[:-size]
            x, lengths = _padded([sequences[i] for i in part])
            scores = self._score(x, lengths)[0]
            for j, i in enumerate(part):
                out[i] = scores[: lengths[j], j]
        return out

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self._weights()]
        step, k = 0, self.there.u.shape[0]
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for s in range(0, len(order), 24):
                part = order[s : s + 24]
                x, lengths = _padded([sequences[i] for i in part])
                y = np.zeros(x.shape[:2], np.float32)
                mask = np.zeros(x.shape[:2], np.float32)
                for j, i in enumerate(part):
                    y[: lengths[j], j], mask[: lengths[j], j] = labels[i], 1
                p, joined, flipped, one, two = self._score(x, lengths, keep=True)
                d = (p - y) * mask / mask.sum()
                dj = d[:, :, None] * self.v
                grads = self.there.backward(x, one, dj[:, :, :k])
                grads += self.back.backward(flipped, two, _flipped(dj[:, :, k : 2 * k], lengths))
                grads += [np.einsum("tb,tbk->k", d, joined), d.sum().reshape(1)]
                step += 1
                for w, g, (m, v) in zip(self._weights(), grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in sequences])
    x = np.zeros((int(lengths.max()), len(sequences), DIMS), np.float32)
    for j, s in enumerate(sequences):
        x[: len(s), j] = s
    return x, lengths


# ── training pages ───────────────────────────────────────────────────────────

_OUTER = set("nav header footer aside form menu dialog button fieldset head".split())
_OUTER_NAMES = set(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget"
    " footer header masthead comment comments respond discussion disqus reply cookie cookies consent notice alert popup modal overlay"
    " newsletter subscribe signup login search form share social related recommended tags pagination pager copyright legal".split()
)
_INNER = ("article", "main")


def marked(block: Block) -> bool:
    """What the markup says: inside the article and inside nothing that is not part of it."""
    inner = False
    for element in block.path:
        tag, _, rest = element.partition(" ")
        if tag in _OUTER and not (tag == "header" and inner) or set(_PART.findall(rest)) & _OUTER_NAMES:
            return False
        inner = inner or tag in _INNER or bool({"content", "article", "post", "main", "entry", "story"} & set(_PART.findall(rest)))
    return inner


def _rebuilt(leaves: list[Block], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """The same texts in other markup, with other boilerplate around and inside."""
    inner = [b for b in leaves if marked(b)]
    outer = [b for b in leaves if not marked(b)] or inner[:1]
    some = [b.text for b in outer]

    def bit() -> str:
        if rng.random() < 0.5 or not inner:
            return rng.choice(some)
        words = rng.choice(inner).text.split()
        return " ".join(words[: rng.randint(1, 25)])

    body = rng.choice([("article",), ("main", "article"), ("main",), ("div .content",), ("div .post-content", ), ("div #main", "div .entry"), ("div .story", "section"), ("div .page", "article .post")])
    top = ("html", "body", *rng.choice([(), (), ("div .wrapper",), ("div #page", "div .container")]))
    before = [("nav", "ul", "li"), ("header",), ("header .masthead", "div"), ("div .menu", "ul", "li"), ("div .ad",), ("div .cookie-notice", "p"), ("aside", "p"), ("div .sidebar", "p"), ("form", "div"), ("div .breadcrumbs",), ("div .banner", "p"), ("div #search", "form")]
    after = [("footer",), ("footer", "p"), ("section #comments", "div .comment", "p"), ("div .comments", "p"), ("aside .related", "ul", "li"), ("form .newsletter", "p"), ("div .share",), ("div .footer", "div"), ("div .ad",), ("ol .commentlist", "li", "p"), ("div .widget", "p"), ("div .advert", "p")]
    within = [("div .ad",), ("aside", "p"), ("div .share",), ("form", "p"), ("div .notice", "p"), ("section .comments", "div", "p"), ("div .newsletter",), ("footer",), ("div .related", "ul", "li")]
    out: list[Block] = []
    labels: list[bool] = []

    def add(path: tuple[str, ...], content: bool, text: str) -> None:
        if not content and rng.random() < 0.35:  # any leaf may stand in boilerplate too
            path = (*path, rng.choice(["p", "p", "div", "h2", "h3", "blockquote"]))
        out.append(Block(path, text, len(text) if path[-1] == "li" and not content else 0))
        labels.append(content)

    for p in rng.sample(before, rng.randint(0, 4)):
        for _ in range(rng.randint(1, 6) if p[-1] == "li" else 1):
            add(top + p, False, bit())
    for i, b in enumerate(inner):
        leaf = b.path[-1:] if rng.random() < 0.8 else (rng.choice(["p", "blockquote", "h2", "li", "pre", "td"]),)
        add(top + body + (leaf if i else (rng.choice(["h1", "h1", "p"]),)), True, b.text)
        if rng.random() < 0.06:
            add(top + body + rng.choice(within), False, bit())
    if rng.random() < 0.3:
        for _ in range(rng.randint(1, 4)):
            add(top + body + rng.choice(within), False, bit())
    for p in rng.sample(after, rng.randint(0, 4)):
        for _ in range(rng.randint(1, 5) if p[-1] in ("li", "p") else 1):
            add(top + p, False, bit())
    return out, labels


def train(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES, seed: int = 5) -> Labeller:
    """A labeller fitted to about ``sample_pages`` pages, at most twice as many, picked by a hash."""
    short = pages.select(html).where(F.length(html) <= SAMPLE_CHARS)
    rows = sorted(r[html] for r in sampled(short, sample_pages, seed).collect())
    rng = random.Random(seed)
    # fewer pages are rebuilt more often, so that every kind of boilerplate is met
    rebuilt = max(4, -(-REBUILT_PAGES // max(1, len(rows))))
    sequences, labels = [], []
    for row in rows:
        leaves = blocks(row)
        if not leaves:
            continue
        versions = [(leaves, [marked(b) for b in leaves]), *(_rebuilt(leaves, rng) for _ in range(rebuilt))]
        for made, wanted in versions:
            x, y = vectors(made), np.array(wanted, np.float32)
            # long pages are learnt window by window
            for s in range(0, len(x), WINDOW):
                sequences.append(x[s : s + WINDOW])
                labels.append(y[s : s + WINDOW])
    return Labeller(seed=seed).fit(sequences, labels, seed=seed) if sequences else Labeller(seed=seed)


# ── extraction ───────────────────────────────────────────────────────────────


def main_text(pages: list[str], labeller: Labeller) -> list[str]:
    leaves = [blocks(p) for p in pages]
    scores = labeller.content([vectors(x) for x in leaves])
    return ["\n".join(b.text for b, s in zip(x, y, strict=True) if s >= 0.5) for x, y in zip(leaves, scores, strict=True)]


def _extract(labeller: Labeller):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                part = batch.slice(s, 128)
                texts = main_text([x or "" for x in part.column(1).to_pylist()], labeller)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return run


def extract(pages: DataFrame, labeller: Labeller | None = None, html: str = "html") -> DataFrame:
    """All other columns with ``text`` and ``n_chars``.

    A null or empty page and one without content has an empty text.  Repeated
    rows give repeated rows; columns named like the results are replaced.
    """
    labeller = labeller or train(pages, html)
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    kept = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    packed = pages.select(kept.alias("key"), F.col(html).alias("html"))
    fields = packed.schema["key"].dataType.simpleString()
    got = packed.mapInArrow(_extract(labeller), f"key {fields}, text string")
    return got.select(*[F.col("key")[c].alias(c) for c in others], "text", F.char_length("text").cast("long").alias("n_chars"))
