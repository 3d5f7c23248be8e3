"""Main text of web pages: a recurrent labeller reads a page's blocks in both directions and keeps or drops each.

A page is cut into blocks of text between block-level tags. A block is described by the tags, classes and ids around it
and by its words, hashed into fixed random vectors, and by a few measures. A bidirectional LSTM in numpy sees the whole
sequence. It learns from weak labels: where the surroundings of a block say what it is (an article, a menu, a comment),
on a bounded sample of the pages and on made-up block sequences that mix such surroundings in many ways, both also with
names that mean nothing, so that it need not know the names of a page.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, smallest_hashes, strings

SAMPLE_PAGES, SAMPLE_CHARS = 300, 100_000  # pages learned from, at most, and their length
MADE_UP, DISGUISES = 700, 2
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN, SLOTS = 48, 12, 6, 16, 1 << 14

# fixed values: elements that end a block, that have no end tag, whose content is no text of the page if they are closed
BLOCK_TAGS = set("""html body main article section aside nav header footer div p ul ol li dl dt dd table caption thead tbody
tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre form fieldset legend figure figcaption address hr details summary dialog
menu center button label option""".split())
CLOSES_ITS_LIKE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
NO_END = {"hr"}
HIDDEN_TAGS = set("template noscript svg iframe object canvas select".split())
TELLING_TAGS = set("main article section aside nav header footer form menu".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")

# fixed values: names that tell what surrounds a block
DROPPED = set("""nav footer aside header form menu navbar navigation sidebar ad ads advert advertisement banner cookie cookies
consent notice notices alert popup modal comment comments respond reply replies discussion share sharing social related
recommended breadcrumb breadcrumbs promo promoted sponsor sponsored newsletter subscribe signup login search widget pagination
pager toolbar topbar masthead copyright legal disclaimer button label option legend dialog complementary contentinfo""".split())
KEPT = set("article main content post entry story body text articlebody maincontent".split())


def random_vectors(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (SLOTS, size)).astype(np.float32)


PATHS, WORDS = random_vectors(1, PATH_SIZE), random_vectors(2, WORD_SIZE)


def slots(tokens) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % SLOTS for t in tokens]


@lru_cache(20_000)
def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the classes, ids and roles of its attributes."""
    found = [tag]
    if attributes and "=" in attributes:
        for groups in NAMES.findall(attributes):
            value = "".join(groups).lower()
            found += [value] if value.isalnum() else [value, *WORD.findall(value)]
    return tuple(found)


@lru_cache(20_000)
def names_vector(names: tuple[str, ...]) -> np.ndarray:
    return PATHS[slots(names)].sum(0)


class Around:
    """An open element: the sum of the vectors of the different names on the way to it, and what these names say.

    Each element adds to the one around it, so that deep nesting takes memory in proportion to the page.
    """

    __slots__ = ("vector", "kept", "article", "dropped")

    def __init__(self, outer: Around | None = None, names: tuple[str, ...] = (), fresh: tuple[str, ...] = ()):
        self.vector = np.zeros(PATH_SIZE, np.float32) if outer is None else outer.vector
        self.kept, self.article, self.dropped = (False, False, False) if outer is None else (outer.kept, outer.article, outer.dropped)
        if fresh:
            self.vector = self.vector + names_vector(fresh)
        for name in names:
            if name in DROPPED:  # the header of an article is part of it
                self.dropped = not (name == "header" and self.article)
            self.kept |= name in KEPT
            self.article |= name == "article"


NOWHERE = Around()


def around(names: tuple[str, ...]) -> Around:
    return Around(NOWHERE, names, tuple(dict.fromkeys(names)))


@dataclass
class TextBlock:
    around: Around
    text: str
    link_chars: int


def closed_elements(page: str, tag: str) -> dict[int, int]:
    """Where each element of a kind that is closed starts and ends."""
    out, open_ = {}, []
    for mark in re.finditer(rf"<(/?){tag}\b[^>]*+(?:>|\Z)", page, re.I):
        if not mark[1]:
            if not mark[0].endswith("/>"):
                open_.append(mark.start())
        elif open_:
            out[open_.pop()] = mark.end()
    return out


class Disguise:
    """Takes the meaning out of the names of one page: strange words for classes and ids, the same one for the same, and
    `div` for the tags that tell what is inside."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.strange = rng, {}

    def __call__(self, name: str) -> str:
        if name in TELLING_TAGS:
            return "div"
        if name in BLOCK_TAGS:
            return name
        if name not in self.strange:
            self.strange[name] = f"name{self.rng.integers(1 << 30)}"
        return self.strange[name]


def blocks_of(page: str, disguise: Disguise | None = None) -> list[TextBlock]:
    """The non-empty blocks of a page in order: references decoded, white space inside turned into one space, trimmed.

    Broken markup is read as far as it goes: an end tag closes all that is open inside, one without a start is ignored.
    Scripts, styles, titles and text areas reach to their end tag or to the end of the page. Drawings, embedded objects and
    the like are left out where they are closed; where not, only the tag is. Formulas are text.
    """
    out: list[TextBlock] = []
    open_: list[tuple[str, Around, tuple[str, ...]]] = []
    seen: set[str] = set()  # the names of all open elements
    tags: Counter = Counter()  # how many of them have a tag
    closed: dict[str, dict[int, int]] = {}
    held: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        if text:
            out.append(TextBlock(open_[-1][1] if open_ else NOWHERE, text, min(links, len(text))))
        held.clear()
        links = 0

    def take(piece: str) -> None:
        nonlocal links
        piece = html.unescape(piece) if "&" in piece else piece
        held.append(piece)
        if in_link:
            links += len(piece)

    def close(place: int) -> None:
        for tag_, _, fresh in open_[place:]:
            tags[tag_] -= 1
            seen.difference_update(fresh)
        del open_[place:]

    while mark := TOKEN.search(page, at):
        if mark.start() > at:
            take(page[at:mark.start()])
        at = mark.end()
        name = mark[3] or mark[6]
        if name is None:
            continue
        tag, closing = name.lower(), bool(mark[2] or mark[5])
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            held.append(" ")
        elif tag in HIDDEN_TAGS:
            if not closing:
                if tag not in closed:
                    closed[tag] = closed_elements(page, tag)
                at = max(at, closed[tag].get(mark.start(), at))
        elif tag in BLOCK_TAGS:
            flush()
            in_link = 0 if closing else in_link
            if closing:
                place = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None) if tags[tag] else None
                if place is not None:
                    close(place)
            elif tag not in NO_END:
                if open_ and (open_[-1][0] == "p" or open_[-1][0] == tag and tag in CLOSES_ITS_LIKE):
                    close(len(open_) - 1)
                names = names_of(tag, mark[4] or mark[7])
                names = tuple(map(disguise, names)) if disguise else names
                fresh = tuple(n for n in dict.fromkeys(names) if n not in seen)
                seen.update(fresh)
                tags[tag] += 1
                open_.append((tag, Around(open_[-1][1] if open_ else NOWHERE, names, fresh), fresh))
    if at < len(page):
        take(page[at:])
    flush()
    return out


# ------------------------------------------------------------------ description of blocks

def describe(blocks: list[TextBlock]) -> np.ndarray:
    """One row a block: its surroundings, its words, its measures."""
    out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
    if not blocks:
        return out
    words = [b.text.lower().split() for b in blocks]
    counts = np.array([len(w) for w in words])
    flat = np.array(slots([x for w in words for x in w]))
    starts = np.cumsum(counts) - counts
    out[:, :PATH_SIZE] = np.tanh(np.stack([b.around.vector for b in blocks]) / 2)
    out[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.add.reduceat(WORDS[flat], starts) / np.sqrt(counts)[:, None] / 2
    length = np.array([len(b.text) for b in blocks])
    out[:, -6] = np.log1p(length) / 5
    out[:, -5] = np.array([b.link_chars for b in blocks]) / length
    out[:, -4] = [b.text[-1] in ".!?…\"»" for b in blocks]
    out[:, -3] = np.minimum(counts, 50) / 50
    out[:, -2] = np.arange(len(blocks)) / len(blocks)
    out[:, -1] = length / max(1, length.max())
    return out


# ------------------------------------------------------------------ the network

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.values: dict[str, np.ndarray] = {}
        for way in "fb":
            self.values[f"x{way}"] = rng.normal(0, size ** -0.5, (size, 4 * hidden)).astype(np.float32)
            self.values[f"h{way}"] = rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.values[f"c{way}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)  # forget gates start open
        self.values["out"] = rng.normal(0, 0.1, (2 * hidden, 1)).astype(np.float32)
        self.values["bias"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, real: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states (pages, blocks, hidden) of one direction; where `real` is 0 the state stays as it is."""
        v, k = self.values, self.hidden
        given = x @ v[f"x{way}"] + v[f"c{way}"]
        h, c = (np.zeros((len(x), k), np.float32) for _ in range(2))
        states, trail = np.zeros((*x.shape[:2], k), np.float32), []
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            gates = given[:, t] + h @ v[f"h{way}"]
            i, f, o = (sigmoid(gates[:, j * k:(j + 1) * k]) for j in range(3))
            g = np.tanh(gates[:, 3 * k:])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            on = real[:, t:t + 1]
            trail.append((t, h, c, i, f, o, g, tanh_c, on))
            h, c = np.where(on, o * tanh_c, h), np.where(on, new_c, c)
            states[:, t] = h
        return states, trail

    def probabilities(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, real, "f")[0], self.run(x, real, "b")[0]], axis=2)
        return sigmoid((both @ self.values["out"])[..., 0] + self.values["bias"])

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over real blocks, back through time."""
        v, k = self.values, self.hidden
        passes = {way: self.run(x, real, way) for way in "fb"}
        both = np.concatenate([passes["f"][0], passes["b"][0]], axis=2)
        error = (sigmoid((both @ v["out"])[..., 0] + v["bias"]) - y) * real / max(1, real.sum())
        grads = {"out": np.einsum("nth,nt->h", both, error)[:, None], "bias": error.sum(keepdims=True)[0]}
        back = error[..., None] * v["out"][:, 0]
        for way, part in (("f", back[..., :k]), ("b", back[..., k:])):
            gx, gh, gc = (np.zeros_like(v[n + way]) for n in "xhc")
            dh = np.zeros((len(x), k), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tanh_c, on in reversed(passes[way][1]):
                dh = dh + part[:, t]
                inner = np.where(on, dc + dh * o * (1 - tanh_c ** 2), 0)
                gates = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f),
                                        np.where(on, dh * tanh_c * o * (1 - o), 0), inner * i * (1 - g ** 2)], axis=1)
                gx += x[:, t].T @ gates
                gh += h.T @ gates
                gc += gates.sum(0)
                dh, dc = np.where(on, 0, dh) + gates @ v[f"h{way}"].T, np.where(on, inner * f, dc)
            grads |= {f"x{way}": gx, f"h{way}": gh, f"c{way}": gc}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, real = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32), np.zeros((len(pages), longest), bool)
    for i, page in enumerate(pages):
        x[i, :len(page)], real[i, :len(page)] = page, True
    return x, real


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 4) -> BlockLabeller:
    """Adam over batches of pages of like length; longer pages are cut into stretches of 64 blocks for training."""
    cut = [(p[i:i + 64], y[i:i + 64]) for p, y in zip(pages, labels) for i in range(0, len(p), 64) if len(p)]
    cut.sort(key=lambda c: len(c[0]))
    groups = [cut[i:i + batch] for i in range(0, len(cut), batch)]
    net, rng, steps = BlockLabeller(PATH_SIZE + WORD_SIZE + MEASURES), np.random.default_rng(seed), 0
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.values.items()}
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, real = padded([p for p, _ in groups[k]])
            y = np.zeros(real.shape, np.float32)
            for i, (_, label) in enumerate(groups[k]):
                y[i, :len(label)] = label
            steps += 1
            for name, grad in net.gradients(x, real, y).items():
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                net.values[name] -= rate * 0.7 ** epoch * (first / (1 - 0.9 ** steps)) / (np.sqrt(second / (1 - 0.99 ** steps)) + 1e-8)
    return net


# ------------------------------------------------------------------ weak labels

def weak_label(block: TextBlock) -> bool | None:
    """What a block's surroundings say; None where they say nothing."""
    return False if block.around.dropped else True if block.around.kept else None


def label_page(blocks: list[TextBlock]) -> np.ndarray:
    """Weak labels; a block whose surroundings say nothing is kept if it is long and hardly linked."""
    said = [weak_label(b) for b in blocks]
    return np.array([len(b.text) >= 80 and b.link_chars < len(b.text) / 3 if s is None else s for b, s in zip(blocks, said)], np.float32)


def made_up_page(rng: np.random.Generator, words: list[str], disguise: Disguise | None = None) -> tuple[list[TextBlock], np.ndarray]:
    """A sequence of blocks in random surroundings, with their labels."""
    def place(*names):
        return around(tuple(map(disguise, names)) if disguise else names)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def text(low, high):
        return " ".join(pick(words) for _ in range(int(rng.integers(low, high)))).capitalize() + pick([".", ".", "", "!"])

    out: list[tuple[TextBlock, int]] = []
    outer = pick([("html", "body"), ("html", "body", "div", "page"), ("html", "body", "div", "wrapper", "div", "container")])
    core = pick([("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post", "div", "entry-content", "entry", "content"),
                 ("section", "story"), ("div", "article-body", "article", "body"), ("div", "main-content", "main", "content")])
    top = [("nav", "ul", "li"), ("header", "div"), ("header", "p"), ("div", "menu", "ul", "li"), ("div", "ad"), ("div", "cookie-notice", "cookie", "notice", "p"),
           ("div", "banner"), ("ul", "breadcrumb", "li"), ("form", "search", "label"), ("div", "topbar", "p"), ("header", "h1"), ("div", "notice")]
    side = [("aside", "p"), ("aside", "ul", "li"), ("div", "sidebar", "ul", "li"), ("div", "sidebar", "p"), ("div", "related", "ul", "li"),
            ("div", "newsletter", "form", "label"), ("div", "share"), ("div", "advert"), ("div", "ad"), ("div", "promo", "p")]
    end = [("footer",), ("footer", "p"), ("div", "footer", "p"), ("section", "comments", "div", "comment", "p"), ("div", "comments", "ul", "li", "p"),
           ("div", "comment-list", "comment", "list", "p"), ("div", "copyright"), ("form", "p"), ("form", "button"), ("div", "widget", "p"), ("div", "legal", "p")]

    def clutter(options, within=()):
        where = pick(options)
        items = int(rng.integers(2, 9)) if "li" in where or "comment" in where else 1
        for _ in range(items):
            wordy = text(6, 60) if rng.random() < (0.7 if "comment" in where or "comments" in where else 0.3) else text(1, 12)
            out.append((TextBlock(place(*outer, *within, *where), wordy, len(wordy) if "li" in where and rng.random() < 0.8 else 0), 0))

    for _ in range(int(rng.integers(0, 4))):
        clutter(top)
    if rng.random() < 0.3:
        clutter(side)
    if rng.random() < 0.85:
        title = text(3, 12)
        out.append((TextBlock(place(*outer, *core, pick(["h1", "h2"])), title, 0), 1))
    for _ in range(int(rng.integers(1, 16))):
        kind = pick([("p",)] * 8 + [("h2",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("figure", "figcaption"), ()])
        body = text(1, 110) if kind in (("p",), ()) else text(1, 25)
        out.append((TextBlock(place(*outer, *core, *kind), body, int(len(body) * 0.2) if rng.random() < 0.2 else 0), 1))
        if rng.random() < 0.2:
            clutter(side, core)
    if rng.random() < 0.3:
        clutter(end[3:6], core)
    for _ in range(int(rng.integers(0, 4))):
        clutter(pick([side, end, end]))
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def fit(pages: DataFrame, bound: int = SAMPLE_PAGES, made_up: int = MADE_UP, disguises: int = DISGUISES) -> BlockLabeller:
    """Learn from at most `bound` different pages, picked by a hash of their html, and from `made_up` sequences of their words.

    Each page comes again `disguises` times with names that mean nothing, and so do half as many made-up sequences: there
    links, words, measures and neighbours have to tell.
    """
    drawn = pages.where(F.length("html").between(1, SAMPLE_CHARS)).select(F.xxhash64("html").alias("draw"), "html")
    total = drawn.agg(F.approx_count_distinct("draw")).first()[0]
    rows = smallest_hashes(drawn.groupBy("draw").agg(F.min("html").alias("html")), "draw", bound, total)
    read = [(r["html"], b) for r in rows if (b := blocks_of(r["html"]))]
    words = sorted({w for _, b in read for x in b for w in x.text.split()[:50]})[:20_000] or ["word", "text", "line", "page"]
    rng = np.random.default_rng(5)
    made = [made_up_page(rng, words) for _ in range(made_up)]
    sample = [(b, label_page(b)) for _, b in read] + made
    for _ in range(disguises):
        sample += [(blocks_of(page, Disguise(rng)), label_page(b)) for page, b in read]
        sample += [made_up_page(rng, words, Disguise(rng)) for _ in range(made_up // 2)]
    return train([describe(b) for b, _ in sample], [y for _, y in sample])


def main_texts(net: BlockLabeller, pages: list[str]) -> list[str]:
    """Kept blocks of each page, joined by line ends. Pages of like length go through the network together."""
    read = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(read) if b), key=lambda i: len(read[i]))
    start = 0
    while start < len(order):
        stop = start + 1  # as many pages as keep the padded batch small
        while stop < len(order) and (stop + 1 - start) * len(read[order[stop]]) <= 8192:
            stop += 1
        part = order[start:stop]
        x, real = padded([describe(read[i]) for i in part])
        for i, p in zip(part, net.probabilities(x, real)):
            out[i] = "\n".join(b.text for b, keep in zip(read[i], p >= 0.5) if keep)
        start = stop
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html): the main text, empty if there is none.

    Null html counts as empty. Rows that repeat, and null ids or urls, come back as they are; other columns are ignored.
    """
    net = fit(pages)

    def run(batches):
        for batch in slices(batches):
            found = main_texts(net, strings(batch, "html"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
