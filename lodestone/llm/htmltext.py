"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between two block-level tags, with the path of elements it stands in. Each block is a vector of
hashed path words (tag names, and the words of class, id and role), hashed text words, and a few measures. A bidirectional
LSTM reads a page's blocks in both directions, so that every block is labelled knowing the whole page, and a logistic layer says how
likely it is main text. Everything is numpy; pages are batched by length.

The labels to learn from are weak: blocks that stand in elements whose names or classes say what they are (LEFT_OUT, CLASSES). About SAMPLE
pages are read for it, in one task, as they are, with blocks of the kinds that they lack put among them, and with their class words made meaningless, so
that texts, links and neighbours have to tell what a block is.
"""

from __future__ import annotations

import functools
import html
import random
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker

#: About how many distinct pages are read to learn from, those with the least hash of id and text; their characters at most.
SAMPLE, SAMPLE_CHARS = 400, 1 << 25
#: The most blocks of a page that are learnt from: a run of them from anywhere in it.
SAMPLE_BLOCKS = 600
#: Blocks that are labelled at once.
AT_ONCE = 10_000
PATH, WORDS, MEASURES, HIDDEN = 128, 32, 6, 16
EPOCHS, RATE = 14, 0.02

# Elements of HTML by what they do to text.
RAW = frozenset("script style noscript template textarea iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes: an open element of the second set, if no element of the third is between.
CLOSES = {
    "p": ({"p"}, {"div", "li", "td", "th", "section", "article", "blockquote", "body"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Elements whose classes tell of the page (such as has-sidebar), not of their text.
WHOLE = frozenset(("html", "body", "main"))
#: Elements, and words of class, id and role, that aren't the article's own text.
LEFT_OUT = frozenset("head title nav header footer aside form button select option menu dialog input label legend fieldset script style noscript".split())
CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navigational menu topbar header masthead footer foot sidebar side aside rail widget "
    "breadcrumb breadcrumbs comment comments commentlist reply replies discussion disqus respond notice notices cookie cookies consent gdpr popup modal overlay alert toast newsletter subscribe signup login "
    "register form search share sharing social related recommended recommendations trending popular pagination pager copyright legal disclaimer complementary contentinfo dialog toolbar".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>=]++|=(?:\s*+(?:\"[^\"]*\"|'[^']*'))?+)*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+").findall


@functools.cache
def raw_end(name: str) -> re.Pattern:
    """The closing tag of an element of RAW; its end is the page's where it has none."""
    return re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I | re.A)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


@functools.lru_cache(20_000)
def named(name: str, rest: str) -> tuple[str, ...]:
    """An opening tag's path words."""
    found = [name]
    for kind, a, b, c in ATTRIBUTE.findall(rest):
        found += [("role:" if kind.lower() == "role" else ".") + w.lower() for w in NAME_WORDS(html.unescape(a or b or c))]
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order: character references decoded, white space one space, those without text left out. Unclosed,
    stray and broken tags do no harm; comments, scripts and styles have no blocks."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    inline = {"a": 0}
    link = 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(w for _, ws in stack for w in ws), text, min(1.0, link / len(text))))
            parts.clear()
            link = 0

    at, n = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if inline["a"]:
                link += m.start() - at
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        rest = m["rest"] or m["rest2"] or ""
        if m["close"] or m["close2"]:
            if name in INLINE:
                if name == "a":
                    inline["a"] = max(0, inline["a"] - 1)
                continue
            flush()
            inline["a"] = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/") or name not in ("svg", "math"):
                end = raw_end(name).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                inline["a"] += 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        inline["a"] = 0
        if name in VOID:
            continue
        if name in CLOSE_P or name in CLOSES:
            shut, wall = CLOSES["p"] if name in CLOSE_P else CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in wall:
                    break
        stack.append((name, named(name, "" if name in WHOLE else rest)))
    if at < n:
        parts.append(page[at:])
    flush()
    return out


class Buckets(dict):
    """Word -> bucket."""

    def __init__(self, n: int, salt: int):
        super().__init__()
        self.n, self.salt = n, salt

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"), self.salt) % self.n
        return b


class Vectors:
    """Blocks as vectors."""

    def __init__(self):
        self.path, self.word = Buckets(PATH, 0), Buckets(WORDS, 77)

    def of(self, page: list[Block], begin: int = 0, end: int | None = None) -> np.ndarray:
        """Of the blocks of a page from begin up to end."""
        part = page[begin:end]
        x = np.zeros((len(part), PATH + WORDS + MEASURES), np.float32)
        for k, b in enumerate(part, begin):
            row = x[k - begin]
            row[[self.path[w] for w in b.path]] = 1
            words = b.text.split(" ")
            found = np.bincount(list(map(self.word.__getitem__, words)), minlength=WORDS)
            row[PATH : PATH + WORDS] = 0.3 * found / np.sqrt(found @ found)
            ends = b.text.count(".") + b.text.count("!") + b.text.count("?")
            row[PATH + WORDS :] = (min(len(words), 400) ** 0.5 / 20, b.linked, min(1.0, ends / 8), k / len(page), 1.0 if k == 0 else 0.0, len(b.text) / len(words) / 20)
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic layer, for batches of pages: x[page, block, feature], mask[page, block]."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d = PATH + WORDS + MEASURES
        self.p = {}
        for way in ("f", "b"):
            self.p[f"W{way}"] = r.normal(0, 0.15, (d, 4 * HIDDEN)).astype(np.float32)
            self.p[f"U{way}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"c{way}"] = bias
        self.p["V"], self.p["v"] = r.normal(0, 0.2, (2 * HIDDEN + d, 1)).astype(np.float32), np.zeros(1, np.float32)
        self.m = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in self.p.items()}
        self.t = 0

    def one_way(self, x: np.ndarray, mask: np.ndarray, way: str, begin: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """The states at every block, and what learn() needs of each step. begin: the states (h, c) to begin with."""
        steps = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        z = x @ self.p[f"W{way}"] + self.p[f"c{way}"]
        h, c = begin or (np.zeros((len(x), HIDDEN), np.float32),) * 2
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            a = z[:, t] + h @ self.p[f"U{way}"]
            i, f, o, g = sigmoid(a[:, :HIDDEN]), sigmoid(a[:, HIDDEN : 2 * HIDDEN]), sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            on = mask[:, t : t + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            kept.append((t, h, c, i, f, o, g, tc, on))
            h, c = on * o * tc + (1 - on) * h, on * c2 + (1 - on) * c
            out[:, t] = h
        self.ended = h, c
        return out, kept

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self.one_way(x, mask, "f")[0], self.one_way(x, mask, "b")[0]
        return sigmoid((np.concatenate([hf, hb, x], 2) @ self.p["V"] + self.p["v"])[..., 0])

    def predict_long(self, page: list[Block], vectors: Vectors) -> np.ndarray:
        """predict() for one page of any number of blocks: each way goes over it AT_ONCE blocks at a time, and hands its states on."""
        sums = np.zeros(len(page), np.float32)
        cuts = [(k, min(len(page), k + AT_ONCE)) for k in range(0, len(page), AT_ONCE)]
        for way, own, parts in (("f", slice(0, HIDDEN), cuts), ("b", slice(HIDDEN, 2 * HIDDEN), cuts[::-1])):
            state = None
            for a, b in parts:
                x = vectors.of(page, a, b)[None]
                h = self.one_way(x, np.ones(x.shape[:2], np.float32), way, state)[0][0]
                state = self.ended
                sums[a:b] += (h @ self.p["V"][own])[:, 0]
                if way == "f":
                    sums[a:b] += (x[0] @ self.p["V"][2 * HIDDEN :])[:, 0]
        return sigmoid(sums + self.p["v"])

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> float:
        """One step of Adam on the mean cross-entropy of the blocks."""
        hf, kf = self.one_way(x, mask, "f")
        hb, kb = self.one_way(x, mask, "b")
        both = np.concatenate([hf, hb, x], 2)
        q = sigmoid((both @ self.p["V"] + self.p["v"])[..., 0])
        e = ((q - y) * mask / mask.sum())[..., None]
        flat = x.reshape(-1, x.shape[2])
        grad = {"V": both.reshape(-1, both.shape[2]).T @ e.reshape(-1, 1), "v": e.sum((0, 1))}
        dh = e @ self.p["V"].T
        for way, kept, own in (("f", kf, dh[..., :HIDDEN]), ("b", kb, dh[..., HIDDEN : 2 * HIDDEN])):
            u = self.p[f"U{way}"]
            da_all, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
            h_next = c_next = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tc, on in reversed(kept):
                d = own[:, t] + h_next
                dc = on * d * o * (1 - tc * tc) + on * c_next
                da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), on * d * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                da_all[:, t] = da
                du += h.T @ da
                h_next, c_next = da @ u.T + (1 - on) * d, dc * f + (1 - on) * c_next
            grad[f"W{way}"], grad[f"U{way}"], grad[f"c{way}"] = flat.T @ da_all.reshape(-1, 4 * HIDDEN), du, da_all.sum((0, 1))
        self.t += 1
        for k, a in self.p.items():
            m, v = self.m[k]
            m += 0.1 * (grad[k] - m)
            v += 0.001 * (grad[k] ** 2 - v)
            a -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
        return float(-(mask * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / mask.sum())


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask = np.zeros((len(pages), n, pages[0].shape[1]), np.float32), np.zeros((len(pages), n), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def weak_label(path: tuple[str, ...]) -> int:
    """1 if nothing on a block's path says that it isn't the article's."""
    return int(not any(w in LEFT_OUT or re.sub(r"^(\.|role:)", "", w) in CLASSES and w not in CLASSES for w in path))


def varied(page: list[Block], r: random.Random) -> list[Block]:
    """A page with blocks of other kinds before, inside and after its own, with texts of its own, and at times other containers."""
    kinds = [("div", "." + w) for w in CLASSES] + [("section", "." + w) for w in CLASSES] + [(t,) for t in LEFT_OUT] + [("ul", "." + w, "li") for w in CLASSES] + [("div", "role:" + w) for w in CLASSES]
    good = [(), ("p",), ("h2",), ("ul", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("section", "p"), ("div", "p"), ("figure", "figcaption"), ("pre",), ("div", ".content", "p"), ("div", ".post", ".body")]
    texts = [b.text for b in page]
    swap = r.choice([None, None, ("main",), ("div", ".content"), ("div", ".article", ".body"), ("main", "article"), ("section", ".post")])
    out = []
    for b in page:
        path = b.path
        if swap and "article" in path:
            k = path.index("article")
            path = path[:k] + swap + path[k + 1 :]
        out.append(Block(path, b.text, b.linked))
        if r.random() < 0.3:
            own = path if weak_label(path) else ("html", "body", *(swap or ("article",)))
            top = next((k for k, w in enumerate(own) if w in ("article", "main")), len(own) - 1) + 1
            text = r.choice(texts)
            if r.random() < 0.6:
                kind = r.choice(kinds)
                where = own[: r.choice([top, max(0, top - 1)])]
                out += [Block((*where, *kind, *r.choice(good)), text if j else " ".join(text.split()[: r.randint(1, 30)]), float(r.random() < 0.3)) for j in range(r.randint(1, 3))]
            else:
                out.append(Block((*own[:top], *r.choice(good)), text, 0.0))
    return out


def unnamed(page: list[Block], r: random.Random) -> list[Block]:
    """A page whose elements have other, meaningless class words: only elements, texts and links, and what stands around them, tell of its blocks."""
    salt = str(r.random())
    other = lambda w: w if w[0] not in ".r" or w[0] == "r" and ":" not in w else f".x{zlib.crc32((salt + w).encode())}"
    return [Block(tuple(map(other, b.path)), b.text, b.linked) for b in page]


def train(pages: list[str], seed: int = 11) -> Labeller:
    """A labeller that has learnt from these pages. Without any it calls what its start values say."""
    r, vectors, model = random.Random(seed), Vectors(), Labeller()
    data = []
    for page in filter(None, map(blocks, pages)):
        begin = r.randint(0, max(0, len(page) - SAMPLE_BLOCKS))
        page = page[begin : begin + SAMPLE_BLOCKS]
        for version, named_ in ((page, True), (varied(page, r), True), (varied(page, r), True), (page, False)):
            for k in range(0, len(version), 200):
                part = version[k : k + 200]
                data.append((vectors.of(part if named_ else unnamed(part, r)), np.array([weak_label(b.path) for b in part], np.float32)))
    for _ in range(EPOCHS):
        r.shuffle(data)
        for k in range(0, len(data), 16):
            group = data[k : k + 16]
            x, mask = padded([g[0] for g in group])
            y = np.zeros(mask.shape, np.float32)
            for j, g in enumerate(group):
                y[j, : len(g[1])] = g[1]
            model.learn(x, mask, y)
    return model


def label(model: Labeller, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
    """Each page's blocks' chances of being main text; pages of like length go together, in batches of bounded size."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[0]])
        if longest > AT_ONCE:
            break
        group = [k for k in order[: max(1, AT_ONCE // (2 * longest))] if len(pages[k]) <= 2 * longest]
        order = order[len(group) :]
        x, mask = padded([vectors.of(pages[k]) for k in group])
        for k, q in zip(group, model.predict(x, mask), strict=True):
            out[k] = q[: len(pages[k])]
    for k in order:
        out[k] = model.predict_long(pages[k], vectors)
    return out


def worker_state(p: dict[str, np.ndarray]) -> tuple[Labeller, Vectors]:
    model = Labeller()
    model.p = p
    return model, Vectors()


def sampled(pages: DataFrame, id_col: str, html_col: str, sample: int) -> DataFrame:
    """h, html: about `sample` distinct pages, all where there are no more. Only they leave their partitions; copies count once."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(html_col))
    most = min(1.0, sample / max(1, pages.count())) * float(1 << 64) - float(1 << 63)
    few = pages.where(F.col(html_col).isNotNull()).select(h.alias("h"), F.col(html_col).alias("html")).where(F.col("h") <= F.lit(most))
    return few.groupBy("h").agg(F.first("html").alias("html"))


def learnt(pages: DataFrame, id_col: str, html_col: str, sample: int) -> dict[str, np.ndarray]:
    """The weights that one task learns from sampled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if size < SAMPLE_CHARS:
                    texts.append(text[: SAMPLE_CHARS - size])
                    size += len(text)
        p = train(texts).p
        yield pa.record_batch([pa.array(list(p)), pa.array([a.shape for a in p.values()], pa.list_(pa.int32())), pa.array([a.tobytes() for a in p.values()])], names=["name", "shape", "weights"])

    one = sampled(pages, id_col, html_col, sample).repartition(1).sortWithinPartitions("h").mapInArrow(run, "name string, shape array<int>, weights binary")
    return {r["name"]: np.frombuffer(bytes(r["weights"]), np.float32).reshape(r["shape"]) for r in one.collect()}  # the labeller's size, whatever the input


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """A row per row of pages: id, url, text (the blocks labelled main text, in page order, joined by a space), n_chars.

    A null or empty page, or one without main text, has an empty text. Pages are read whole, whatever their length and number of
    blocks. Repeated rows are treated alike. Empty table: no rows; nothing is learnt from null pages. Other columns are not looked at.
    """
    shared, key = pages.sparkSession.sparkContext.broadcast(learnt(pages, id_col, html_col, sample)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, vectors = in_worker(key, lambda: worker_state(shared.value))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                texts = [" ".join(b.text for b, q in zip(p, qs, strict=True) if q > 0.5) for p, qs in zip(found, label(labeller, found, vectors), strict=True)]
                yield pa.record_batch([*part.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind, url = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` {url}, text string, n_chars long")
