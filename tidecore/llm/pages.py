"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page.

A page is cut into leaf blocks, the texts between block-level tags. Each block is a
vector of its tag path (tags, class and id words, hashed), its words (hashed), its
length and its share of link text. The LSTM reads the blocks of a page in both directions, so
the whole page decides about each one.

Pages have no labels, so the network learns from two bounded sources: pages of the
table whose tags say what is the article (``article``, ``main`` against ``nav``, ``footer`` and
the like), and pages put together from their texts in common layouts, also ones without such tags.

The project has no records of web pages, so this operator is general.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm import bilstm
from tidecore.llm.labelled import different_texts
from tidecore.llm.memory import lean
from tidecore.llm.runs import signs

# Pages the network is trained on, at most, their longest, and composed ones beside them.
TRAIN_PAGES, TRAIN_CHARS, COMPOSED = 300, 200_000, 900
# Blocks of a training page that are read, at most: a bound on training alone.
TRAIN_BLOCKS = 48
PATH_ROWS, PATH_WIDTH, TAG_WIDTH, WORD_ROWS, WORD_WIDTH, HIDDEN = 4096, 32, 12, 4096, 8, 16
STEPS, BATCH, RATE = 400, 32, 1e-2
# Pages labelled together.
TOGETHER = 64

# Tags.
RAW = frozenset("script style template textarea iframe title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the first kind ends an open element of the second.
ENDS = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# What tags and class words say in pages that use them.
MAIN_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav footer aside form button select dialog".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "footer form header menu nav navbar navigation newsletter notice popup promo promoted related respond sidebar "
    "share social sponsor sponsored subscribe toolbar widget".split()
)

# Elements of a block's path that are read: the outermost and the innermost so many.
PATH_ENDS = 12

_OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: hashed-path words, innermost tag, text, and characters of it in links."""

    path: tuple[str, ...]
    tag: str
    text: str
    linked: int


class _Markup:
    """Where tags end, in time that follows the page: what a failed look ahead has seen is not looked at again."""

    def __init__(self, html: str):
        self.html = html
        self.special = [m.start() for m in re.finditer("[\"'>]", html)]
        self.dead: set[int] = set()
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.missing: dict[str, int] = {}

    def after(self, text: str, at: int) -> int:
        """The place behind the next ``text``, the end of the page where there is none."""
        if at >= self.missing.get(text, len(self.html)):
            return len(self.html)
        found = self.html.find(text, at)
        if found < 0:
            self.missing[text] = at
            return len(self.html)
        return found + len(text)

    def tag_end(self, at: int) -> int:
        """The place behind the ``>`` that closes a tag whose attributes begin at ``at``, or -1; quoted ones are skipped."""
        seen = []
        while True:
            k = bisect_left(self.special, at)
            if k == len(self.special) or self.special[k] in self.dead:
                break
            here = self.special[k]
            quote = self.html[here]
            if quote == ">":
                return here + 1
            seen.append(here)
            if here >= self.last[quote]:
                break
            at = self.html.find(quote, here + 1) + 1
        self.dead.update(seen)
        return -1


def leaf_blocks(html: str) -> list[Block]:
    """The texts between block-level tags, in page order; white space in a block is one space.

    Time follows the length of the page, however broken or deeply nested it is. A ``<`` that opens no tag is text.
    Scripts, styles, templates, frames and input areas are left out; one that is never closed, a script or style aside, leaves
    out nothing. Of a path deeper than twice ``PATH_ENDS`` the ends are kept.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    links, linked = 0, 0
    at, text_from, size = 0, 0, len(html)
    markup, closing = _Markup(html), {}

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                near = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
                path = tuple(w for tag, words in near for w in (tag, *words))
                out.append(Block(path, stack[-1][0] if stack else "", text, min(linked, len(text))))
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            held.append(text)
            if links > 0:
                linked += len(text.strip())

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while m := _OPENING.search(html, at):
        kind, tag = m[0], m[2]
        if tag is None:
            if kind == "<!--":
                end = markup.after("-->", m.end())
            elif kind == "<![CDATA[":
                end = markup.after("]]>", m.end())
            else:
                end = markup.after(">", m.end()) if m.end() <= markup.last[">"] else -1
        else:
            end = markup.tag_end(m.end())
        if end < 0:
            at = m.start() + 1  # no markup after all
            continue
        add(html[text_from : m.start()])
        at = text_from = end
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), m[1] == "/", html[m.end() : end - 1]
        alone = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not ending and not alone:
                # the next closing tag of its name; none follows once none was found
                if closing.get(tag) is not False:
                    stop = closing.get(tag)
                    if stop is None or stop.start() < at:
                        stop = closing[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) or False
                else:
                    stop = False
                if stop:
                    at = text_from = stop.end()
                elif tag in ("script", "style"):
                    at = text_from = size
                held.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if ending else 1))
            continue
        close()
        links = 0
        if ending:
            if opened.get(tag):
                while leave() != tag:
                    pass
            continue
        gone = ENDS.get(tag, frozenset(["p"]) if tag in CLOSES_P else frozenset())
        while stack and stack[-1][0] in gone:
            leave()
        if tag not in VOID and not alone:
            words = tuple("." + w for a in _NAMED.findall(attributes) for w in _WORD.findall("".join(a).lower())) if attributes else ()
            stack.append((tag, words))
            opened[tag] = opened.get(tag, 0) + 1
    add(html[text_from:])
    close()
    return out


def tagged(blocks: list[Block]) -> list[int]:
    """What the tags say: 1 inside ``article`` or ``main`` and in nothing that is known not to be it."""
    return [int(any(w in MAIN_TAGS for w in b.path) and not any(w in OTHER_TAGS or w[0] == "." and w[1:] in OTHER_WORDS for w in b.path)) for b in blocks]


# --- features --------------------------------------------------------------

_PATH, _TAG, _WORDS = (signs(21, PATH_ROWS, PATH_WIDTH, 6), signs(22, 256, TAG_WIDTH, 4), signs(23, WORD_ROWS, WORD_WIDTH, 2))
INPUTS = PATH_WIDTH + TAG_WIDTH + WORD_WIDTH + 6
_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _PATHS.get(path)
    if found is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        found = np.zeros(PATH_WIDTH, np.float32)
        for w in path:
            found += _PATH[crc32(w.encode()) % PATH_ROWS]
        found /= max(1, len(path)) ** 0.5
        _PATHS[path] = found
    return found


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: tag path, innermost tag, words, length, links, ends, place."""
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.split()
        at = np.array([hash_word(w) for w in words])
        out[i, :PATH_WIDTH] = _path_vector(b.path)
        out[i, PATH_WIDTH : PATH_WIDTH + TAG_WIDTH] = _TAG[crc32(b.tag.encode()) % 256]
        k = PATH_WIDTH + TAG_WIDTH
        out[i, k : k + WORD_WIDTH] = _WORDS[at].mean(0)
        k += WORD_WIDTH
        out[i, k : k + 6] = (np.log1p(len(words)) / 3, np.log1p(len(b.text)) / 5, b.linked / len(b.text), b.text[-1] in ".!?", i == 0, i == len(blocks) - 1)
    return out


def hash_word(word: str) -> int:
    return crc32(word.lower().encode()) % WORD_ROWS


# --- training pages --------------------------------------------------------

_HOLDERS = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".content", ".main"), ("div", ".post"), ("section", ".entry", ".content"), ("div", ".article", ".body"), ("div", ".story"), ("div",), ("div", "div"), ("section",), ("td",), ())
_OTHERS = (
    ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header",), ("header", "div"), ("div", ".header"), ("div", ".nav", "ul", "li"), ("footer",), ("footer", "p"),
    ("div", ".footer"), ("div", ".footer", "p"), ("aside", "p"), ("aside",), ("div", ".sidebar"), ("div", ".sidebar", "p"), ("div", ".ad"), ("div", ".ads"), ("div", ".advert"),
    ("div", ".banner"), ("div", ".sponsored", "p"), ("div", ".cookie", ".notice"), ("div", ".cookie", "p"), ("div", ".notice"), ("div", ".consent", "p"), ("form",), ("form", "p"),
    ("form", "button"), ("form", "select", "option"), ("div", ".comments", "p"), ("section", ".comments", "div", ".comment", "p"), ("ol", ".comments", "li", ".comment", "p"), ("div", ".comment"),
    ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".newsletter", "p"), ("ul", ".breadcrumb", "li"), ("div", ".widget"), ("div", ".promo"), ("div", ".copyright"), ("dialog", "p"),
)


def compose(rng: np.random.Generator, texts: list[str]) -> tuple[list[Block], list[int]]:
    """A page in a common layout, from other pages' texts."""
    pick = lambda: texts[int(rng.integers(len(texts)))]
    short = lambda: " ".join(pick().split()[: int(rng.integers(1, 9))])
    blocks: list[Block] = []
    labels: list[int] = []
    root = ("html", "body") if rng.random() < 0.8 else ("html", "body", "div")

    def other(kinds, inside=()):
        path = kinds[int(rng.integers(len(kinds)))]
        for _ in range(int(rng.integers(2, 8)) if path[-1] in ("li", "option") else int(rng.integers(1, 4))):
            text = short() if path[-1] in ("li", "option", "button") or rng.random() < 0.4 else pick()
            linked = len(text) if path[-1] == "li" and rng.random() < 0.9 else 0
            blocks.append(Block((*root, *inside, *path), _last(path), text, linked))
            labels.append(0)

    for _ in range(int(rng.integers(0, 4))):
        other(_OTHERS)
    holder = _HOLDERS[int(rng.integers(len(_HOLDERS)))]
    plain = not any(w in MAIN_TAGS or w[0] == "." for w in holder)
    if rng.random() < 0.7:
        blocks.append(Block((*root, *holder, "h1"), "h1", short(), 0))
        labels.append(1)
    for _ in range(int(rng.integers(2 if plain else 1, 14))):
        inner = ("p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "")[int(rng.integers(12))]
        if inner == "" and plain:
            inner = "p"
        path = (*root, *holder, *(("ul", "li") if inner == "li" else (inner,) if inner else ()))
        blocks.append(Block(path, _last(path), short() if inner[:1] == "h" else pick(), 0))
        labels.append(1)
        if rng.random() < 0.06:
            other(_OTHERS, holder)
    for _ in range(int(rng.integers(0, 4))):
        other(_OTHERS, holder if rng.random() < 0.2 else ())
    return blocks, labels


def _last(path: tuple[str, ...]) -> str:
    return next((w for w in reversed(path) if w[0] != "."), "")


@dataclass
class BlockModel:
    weights: dict[str, np.ndarray]

    def chances(self, pages: list[np.ndarray], keep: bool = False):
        """Scores (time, page) of each block, padded at the end, with the mask."""
        w = self.weights
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), np.float32)
        for b, p in enumerate(pages):
            x[: len(p), b], mask[: len(p), b] = p, 1
        out, memory = bilstm.scores(w, x @ w["fx"] + w["fb"], x @ w["rx"] + w["rb"], mask, keep)
        return out[:, :, 0], mask, x, memory

    def main_texts(self, htmls: list[str]) -> list[str]:
        """The blocks labelled as article of each page, joined by one space."""
        pages = [leaf_blocks(h) for h in htmls]
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        for k in range(0, len(order), TOGETHER):
            own = order[k : k + TOGETHER]
            z = self.chances([vectors(pages[i]) for i in own])[0]
            for b, i in enumerate(own):
                out[i] = " ".join(block.text for t, block in enumerate(pages[i]) if z[t, b] > 0)
        return out


def fit(htmls: list[str]) -> BlockModel:
    """Train on the pages' own tags and on composed pages; without usable pages on made-up words."""
    rng = np.random.default_rng(9)
    real = [(b, tagged(b)) for b in map(leaf_blocks, htmls)]
    real = [(b, y) for b, y in real if any(y)]
    texts = [x.text for b, y in real for x, k in zip(b, y, strict=True) if k][:5000]
    texts = texts or ["word " * n + "end." for n in range(3, 60)]
    data = []
    for b, y in real + [compose(rng, texts) for _ in range(COMPOSED)]:
        if len(b) > TRAIN_BLOCKS:  # keep both ends of a long page
            half = TRAIN_BLOCKS // 2
            b, y = b[:half] + b[-half:], y[:half] + y[-half:]
        data.append((vectors(b), np.array(y, np.float32)))
    w = bilstm.init(rng, INPUTS, HIDDEN, 1)
    model, adam = BlockModel(w), bilstm.Adam(w, RATE)
    for step in range(STEPS):
        adam.rate = RATE * (1 - 0.9 * step / STEPS)
        batch = [data[i] for i in rng.integers(0, len(data), BATCH)]
        z, mask, x, memory = model.chances([v for v, _ in batch], keep=True)
        y = np.zeros_like(z)
        for b, (_, own) in enumerate(batch):
            y[: len(own), b] = own
        d = ((bilstm.sigmoid(z) - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g, gates_f, gates_r = bilstm.slopes(w, d, memory)
        flat = x.reshape(-1, INPUTS)
        for k, gates in (("f", gates_f), ("r", gates_r)):
            g[f"{k}x"], g[f"{k}b"] = flat.T @ gates.reshape(-1, gates.shape[2]), gates.reshape(-1, gates.shape[2]).sum(0)
        adam.update(w, g)
    return model


# --- Spark -----------------------------------------------------------------


def main_texts(pages: DataFrame) -> DataFrame:
    """Main text of every page of ``(u, html)``: ``(u, text)``, one row per row.

    Whole pages are read. Null and empty pages, and pages without an article, give
    an empty text; equal pages give equal texts; other columns are ignored. Character references are
    decoded. The network is trained on at most ``TRAIN_PAGES`` pages, taken by hash; an empty
    table gives an empty result.
    """
    pool = pages.where(F.length("html").between(1, TRAIN_CHARS))
    model = fit(different_texts(pool, "html", TRAIN_PAGES))

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = model.main_texts([h or "" for h in part["html"].to_pylist()])
                yield pa.record_batch([part["u"], pa.array(texts, pa.string())], names=["u", "text"])

    kind = T.StructType([T.StructField("u", pages.schema["u"].dataType), T.StructField("text", T.StringType())])
    return pages.select("u", "html").mapInArrow(lean(run), kind)
