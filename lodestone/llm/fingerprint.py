"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of a symbol become one. Then deterministic coin tossing: a symbol's label is the place and value
of the lowest bit in which it differs from its left neighbour, and from 64-bit names four rounds leave labels below six. A phrase
begins at every local maximum of the labels, so it is two to a dozen symbols long and where it begins depends on a few
symbols around it alone. A phrase's name is a hash of its symbols, and the names are the next level's symbols. So equal substrings have
equal phrases, but for their ends, wherever they stand.

Levels are built until a text has no more than TOP names; the hash of these, in order, names the whole text. The fingerprint is that name and
a sketch: of the names of the levels LEVELS, the least in each of BINS bins. Likeness is worked out from all names of these levels, not from the
sketch: what two texts share of their distinct phrases.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed

#: Mean phrase lengths are some 9 and 30 characters.
LEVELS = (2, 3)
BINS = 64
#: Two neighbours can be two phrases for many levels, but above this many names each level has fewer than the one below.
TOP = 8
#: Bits of a name in the sets that are compared; a text's number among those handled at once stands above them.
NAME = 44
#: Characters handled at once.
CHARS = 100_000
U = np.uint64


def toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place and value of the lowest bit in which each label differs from its left neighbour. A text's first has place 0."""
    one = label.dtype.type(1)
    differ = np.empty_like(label)
    np.bitwise_xor(label[1:], label[:-1], out=differ[1:])
    differ[first] = one
    bit = np.bitwise_count(~differ & (differ - one))
    return bit << np.uint8(1) | (label >> bit.astype(label.dtype) & one).astype(np.uint8)


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of many texts: (names, whether a name is its text's first) from those of the level before."""
    keep = first.copy()
    keep[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(keep)
    if len(at) < len(x):
        run = np.diff(np.append(at, len(x)))
        x, first, long = x[at], first[at], np.flatnonzero(run > 1)
        x[long] = mixed(x[long] + mixed(run[long].astype(U)))
    starts = np.flatnonzero(first)
    label = toss(x, starts)
    for _ in range(3):
        label = toss(label, starts)
    begins = first.copy()
    rises = label[1:] > label[:-1]
    begins[1:-1] |= rises[:-1] & ~rises[1:]  # neighbours differ, so what doesn't rise falls
    if len(starts) > 1:  # a text's last and first neither rise nor fall towards each other
        ends = starts[1:] - 1
        begins[ends] = first[ends] | ((label[ends] > label[ends - 1]) & (ends > 0))
        second = starts[starts < len(x) - 1] + 1
        inner = second[~first[second]]
        last = np.isin(inner, np.append(ends, len(x) - 1))
        after = np.minimum(inner + 1, len(x) - 1)
        begins[inner] = (label[inner] > label[inner - 1]) & (last | (label[inner] > label[after]))
    if len(x) > 1 and not first[-1]:
        begins[-1] = rises[-1]
    at = np.flatnonzero(begins)
    place = np.arange(len(x), dtype=np.int64) - np.repeat(at, np.diff(np.append(at, len(x))))
    part = x * U(0xBF58476D1CE4E5B9) + place.astype(U) * U(0x9E3779B97F4A7C15)
    part = (part ^ part >> U(29)) * U(0x94D049BB133111EB)
    return mixed(np.add.reduceat(part ^ part >> U(32), at)), first[at]


class Prints:
    """The fingerprints of texts handled at once. What a text gets depends on that text alone; an empty text has no names."""

    def __init__(self, texts: list[str]):
        real = np.flatnonzero([len(t) for t in texts])
        self.top, keys = np.zeros(len(texts), U), []
        x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
        first, level = np.zeros(len(x), bool), 0
        first[np.cumsum([0, *(len(texts[i]) for i in real[:-1])])[: len(real)]] = True
        while len(x):
            level += 1
            x, first = parse(x, first)
            starts = np.flatnonzero(first)
            n = np.diff(np.append(starts, len(x)))
            if level in LEVELS:
                keys.append(np.repeat(real.astype(U), n) << U(NAME) | mixed(x + U(level)) >> U(64 - NAME))
            if level >= max(LEVELS):
                place = np.arange(len(x)) - np.repeat(starts, n)
                whole, done = mixed(np.add.reduceat(mixed(x + mixed(place.astype(U))), starts) + U(level)), n <= TOP
                self.top[real[done]] = whole[done]
                on = np.repeat(~done, n)
                x, first, real = x[on], first[on], real[~done]
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, U)
        own, self.name = (keys >> U(NAME)).astype(np.int64), keys & U((1 << NAME) - 1)
        self.size = np.bincount(own, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size
        bits = np.maximum(self.name // U(BINS) & U(0xFFFF), U(1)).astype(np.uint16)  # 0 is an empty bin
        self.sketch = np.zeros(len(texts) * BINS, np.uint16)
        self.sketch[(own * BINS + (self.name % U(BINS)).astype(np.int64))[::-1]] = bits[::-1]  # names ascend: the last to be put is the least
        self.sketch = self.sketch.reshape(-1, BINS)

    def text(self, i: int) -> str:
        """Fingerprint i: 16 hex digits of the whole text's name, then 4 a bin."""
        return f"{int(self.top[i]):016x}{self.sketch[i].astype('>u2').tobytes().hex()}"

    def _names(self, rows: np.ndarray) -> np.ndarray:
        n = self.size[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.name[at] | np.repeat(np.arange(len(rows)).astype(U), n) << U(NAME)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The share of the distinct phrases of texts a[k] and b[k] that both have; two empty texts are alike."""
        both = np.sort(np.concatenate([self._names(a), self._names(b)]))
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> U(NAME)).astype(np.int64), minlength=len(a))
        either = self.size[a] + self.size[b] - common
        return np.where(either > 0, common / np.maximum(either, 1), 1.0)


def edited(text: str, other: str) -> str:
    """text with its last half replaced by as much of the beginning of other, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, tail, id, text): parts of docs by descending id, null ids last, each in order in one partition, and after each, as its tail,
    the first row of the part that follows; the first part follows the last. Rows of one id are in the order of a hash of their texts; an id, or
    null, that has many rows is split by that hash. Texts are shuffled once."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = F.expr(f"approx_percentile(id, array({', '.join(f'{i / n}D' for i in range(1, n))}), 20000)")
    found, missing, all_ = rows.select(quantiles, F.count_if(F.isnull("id")), F.count(F.lit(1))).first()
    times = Counter(found or [])
    bounds = sorted(times)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b >= F.col("id")))
    pieces = F.when(F.isnull("id"), n * missing // max(all_, 1) + 1)  # of an id, as many as bounds fell on it
    if hot := [x for b in bounds if times[b] > 1 for x in (F.lit(b).cast("long"), F.lit(times[b]))]:
        pieces = pieces.otherwise(F.create_map(*hot)[F.col("id")])
    place = F.coalesce(F.shiftright((F.shiftright("hash", 33) + (1 << 30)) * pieces, 31), F.lit(n))  # a hot id is its part's first
    part = F.when(F.isnull("id"), len(bounds) + 1).otherwise(part) * (n + 1) + place
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("part", part)
    heads = sorted(rows.groupBy("part").agg(F.min(F.struct(F.bitwise_not("id").alias("id"), "hash")).alias("head")).select("part", "head.*").collect())  # a row a part
    parts = docs.sparkSession.createDataFrame([(None if i is None else ~i, h, heads[k - 1][0]) for k, (_, i, h) in enumerate(heads)], "head long, head_hash long, before long")
    marked = rows.join(F.broadcast(parts), F.expr("id <=> head and hash = head_hash"), "left")
    both = marked.select("id", "text", "hash", F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("tail")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("tail")))))).alias("at"))
    both = both.select("at.part", "at.tail", "id", "text", "hash").repartition(n // 4, "part")
    return both.sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), "hash").drop("hash")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its last half replaced by the beginning of the next document's, in order of descending id; the
    first follows the last, and an only row follows itself. Null texts are empty; an empty text's fingerprint is all zeros, and it
    is like another empty one only. Null ids come last; rows of one id, in the order of a hash of their texts. Empty table: no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, str]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [k for k in range(len(held) - 1) if not held[k][1] and held[k][0] == held[k + 1][0]]
            texts = [h[3] for h in held]
            after = [edited(texts[k], texts[k + 1]) for k in rows]
            prints = Prints(texts + after)
            own, new = np.array(rows, np.int64), len(texts) + np.arange(len(rows))
            yield pa.record_batch([
                pa.array([held[k][2] for k in rows], pa.int64()), pa.array([len(texts[k]) for k in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in after], pa.string()),
                pa.array([prints.text(i) for i in own], pa.string()), pa.array([prints.text(i) for i in new], pa.string()),
                pa.array(prints.likeness(own, new), pa.float64()), pa.array(prints.likeness(own, own + 1), pa.float64()),
            ], names=names)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= CHARS:
                    yield from flush()
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield from flush()

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, schema)
