"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER: how often each symbol (a byte, or a document's end) follows each context in the
training documents. A symbol is coded in the longest context of the trie that has it; each longer one is escaped from, with the
chance that method C gives (its distinct symbols against its count), and the symbols of the context escaped from are
excluded from the next shorter one. Below the empty context all symbols left are equally likely. The probabilities of all symbols add up to one.

Gathering: the trie has every n-gram of the training documents. It is never in one place: its contexts of three symbols and more are dealt
over parts by their last three, and only orders below that, which the alphabet bounds, are shared with the tasks. Documents go in blocks;
a block asks each part once for the chance of each of its distinct n-grams, and adds up what comes back for each document. A part
sums the counts of all blocks as they come, and a block reads its texts again a few at a time, so neither holds more than what is distinct. Beside it
the words' counts, of all words, give the base score: the most frequent, at most HEAVY, are shared with the tasks; a block asks for its other
words like for its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .langid import held_out
from .shingles import LOWER, WordHashes, mixed, word_hashes
from .tables import Table

ORDER, HEAVY = 5, 400_000
#: If set, n-grams that don't make up more than one KEEP-th of all training symbols are left out. All are kept otherwise.
KEEP: int | None = None
#: Orders below DEALT are shared with the tasks.
DEALT = 3
#: A symbol has BITS bits: 0 before a document's first byte, byte + 1, then its end.
BITS, END, SYMBOLS = 9, 257, 257
#: Bytes handled at once; distinct n-grams and words that a task holds before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 21
#: Symbols of a block of documents, which ends sooner at HELD distinct n-grams; training symbols for each part of the trie.
BLOCK, PART = 1 << 25, 1 << 23
#: The document's end as a word: no word has a space.
END_WORD = xxhash.xxh3_64_intdigest(b" ")
U = np.uint64
WORD, GRAM = 0, 1
DOCUMENT, ASK, TEXT = 0, 1, 2
#: The log10 of the smoothed count of a word that the training documents don't have.
UNSEEN = -1.0


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each with its end, ORDER pads before each; where each text's symbols begin)."""
    pad = b"\0" * ORDER
    at = np.cumsum([0, *(len(t) + 1 + ORDER for t in texts)])
    raw = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.uint16) + np.uint16(1)
    for k in range(ORDER):
        raw[at[:-1] + k] = 0
    raw[at[1:] - 1] = END
    return raw, at[:-1] + ORDER


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(every symbol with the ORDER before it, packed; where each text's begin, and the end)."""
    raw, begins = symbols(texts)
    g = np.zeros(len(raw), U)
    for k in range(ORDER + 1):
        g[ORDER:] |= raw[k : len(raw) - ORDER + k].astype(U) << U(BITS * (ORDER - k))
    real = np.ones(len(raw), bool)
    for k in range(1, ORDER + 1):
        real[begins - k] = False
    return g[real], np.cumsum([0, *(len(t) + 1 for t in texts)])


def tail(size: int) -> np.uint64:
    """The mask of a packed n-gram's last symbols."""
    return U((1 << BITS * size) - 1)


def part_of(g: np.ndarray, parts: int) -> np.ndarray:
    """The part of the trie that has the contexts of DEALT symbols and more of each packed symbol."""
    return (mixed((g >> U(BITS)) & tail(DEALT)) % U(parts)).astype(np.int32)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def words(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of all texts' words, each text's with its end; how many each has)."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) + 1 for w in split], np.int64)
    return np.fromiter((x for w in split for x in [*map(hashes.__getitem__, w), END_WORD]), U, sizes.sum()), sizes


def count(docs: DataFrame) -> DataFrame:
    """kind, key, n: of the training rows' texts, the counts of word hashes and of packed n-grams of order DEALT - 1, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"])

        hashes, held = word_hashes(), {WORD: ([], []), GRAM: ([], [])}
        for batch in batches:
            for part in chunks([(t or b"").translate(LOWER) for t in batch.column(0).to_pylist()]):
                for kind, found in ((WORD, words(part, hashes)[0]), (GRAM, grams(part)[0] & tail(DEALT))):
                    keys, counts = held[kind]
                    k, c = np.unique(found, return_counts=True)
                    keys.append(k), counts.append(c.astype(np.int64))
                    if len(keys) >= 8:
                        k, c = summed(keys, counts)
                        held[kind] = [k], [c]
                        if len(k) >= HELD:
                            yield out(kind, k, c)
                            held[kind] = [], []
        for kind, (keys, counts) in held.items():
            if keys:
                yield out(kind, *summed(keys, counts))

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """A trie, or a part of one, with every chance worked out. counts[d]: (packed context and symbol of order d, n), in order of keys.
    totals[d]: (packed context, n of all its symbols, kept or not), in order. below: the trie of the lower orders, whole."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]], below: Trie | None = None):
        lists = "pairs nodes lp down room esc n count node_n node_q node_r".split()
        for name in lists:
            setattr(self, name, list(getattr(below, name)) if below else [])
        for d, ((keys, n), (contexts, every)) in enumerate(zip(counts, totals, strict=True), len(self.pairs)):
            context = keys >> U(BITS)
            nodes, place = np.unique(context, return_inverse=True)
            whole = every[np.searchsorted(contexts, nodes)].astype(float)
            q, kept = np.bincount(place, minlength=len(nodes)).astype(float), np.bincount(place, n, len(nodes))
            self.pairs.append(Table(keys)), self.nodes.append(Table(nodes))
            self.lp.append(np.log10(n / (whole + q)[place]))
            self.esc.append(np.log10(np.maximum((q + whole - kept) / (whole + q), 1e-300)))
            self.node_n.append(whole), self.node_q.append(q), self.node_r.append(whole - kept)
            room, down = np.zeros(len(nodes)), np.zeros(len(nodes))
            if d:
                # the shorter context without the symbols of this one: those have all been kept there, too
                parent = self.nodes[d - 1].at(nodes & tail(d - 1))
                short = keys & tail(d)
                taken = np.bincount(place, self.count[d - 1][self.pairs[d - 1].at(short)], len(nodes))
                left, symbols_left = self.node_n[d - 1][parent] - taken, self.node_q[d - 1][parent] - q
                room = np.log10(np.maximum(left + symbols_left, 1e-9))
                escape = symbols_left + self.node_r[d - 1][parent]
                down = np.where(left + symbols_left > 0, np.log10(np.maximum(escape, 1e-9)) - room, 0.0)
            self.room.append(room), self.down.append(down)
            self.count.append(n), self.n.append(np.log10(n))
        known = len(self.n[0])
        self.rest = -np.log10(max(SYMBOLS - known, 1)) if known else -np.log10(SYMBOLS)

    def score(self, g: np.ndarray) -> np.ndarray:
        """The log10 probability of each packed symbol after its context."""
        out = np.zeros(len(g))
        left, child = np.arange(len(g)), None  # child: the node of the order above that was escaped from, or -1
        for d in range(ORDER, -1, -1):
            key = g & U((1 << BITS * (d + 1)) - 1) if d < ORDER else g
            pair = self.pairs[d].at(key)
            hit = pair >= 0
            lp = self.lp[d][pair[hit]]
            if child is not None:
                from_child = child[hit] >= 0
                lp = np.where(from_child, self.n[d][pair[hit]] - self.room[d + 1][child[hit]] if len(self.room[d + 1]) else 0.0, lp)
            out[left[hit]] += lp
            miss = ~hit
            node = self.nodes[d].at(key[miss] >> U(BITS))
            there = node >= 0
            cost = np.zeros(len(node))
            cost[there] = self.esc[d][node[there]]
            if child is not None and len(self.down[d + 1]):
                up = child[miss]
                cost = np.where(there & (up >= 0), self.down[d + 1][up], cost)
            left, g, child = left[miss], g[miss], node
            out[left] += cost
        out[left] += self.rest
        return out


def levels(g: np.ndarray, n: np.ndarray, orders: range, every: int, keep: int | None, below: Trie | None = None) -> Trie:
    """The trie of the orders from the counts of the n-grams of the last of them."""
    counts, totals = [], []
    for d in orders:
        k, c = summed([g & tail(d + 1)], [n])
        totals.append(summed([k >> U(BITS)], [c]))
        kept = c * keep > every if keep else c > 0
        counts.append((k[kept], c[kept].astype(float)))
    return Trie(counts, totals, below)


def short(counted: DataFrame, every: int) -> Trie:
    """The trie of the orders below DEALT, from count()'s rows: however large the input, no more than the alphabet has of such n-grams."""
    found = counted.where(F.col("kind") == GRAM).select("key", "n").toPandas()
    return levels(found["key"].to_numpy(np.int64).view(U), found["n"].to_numpy(np.int64), range(DEALT), every, KEEP)


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def whole(blob: bytes) -> bytes:
    return pa.Codec("zstd", 1).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def packed(texts: list[bytes]) -> bytes:
    return squeezed(np.array([len(texts), *map(len, texts)], np.int64).tobytes() + b"".join(texts))


def unpacked(blob: bytes) -> list[bytes]:
    raw = whole(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = (8 * (n + 1) + np.cumsum([0, *np.frombuffer(raw, np.int64, n, 8).tolist()])).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def by_bytes(x: np.ndarray) -> bytes:
    """Compressed: all numbers' first bytes, then all their second ones, and so on."""
    return squeezed(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def grams_to_blob(g: np.ndarray) -> bytes:
    return by_bytes(np.concatenate([(g >> U(BITS * k) & tail(1)).astype(np.uint16) for k in range(ORDER + 1)]))


def grams_from_blob(blob: bytes) -> np.ndarray:
    each = numbers(whole(blob), np.uint16).reshape(ORDER + 1, -1).astype(U)
    return np.bitwise_or.reduce([x << U(BITS * k) for k, x in enumerate(each)])


def chances_to_blob(lp: np.ndarray) -> bytes:
    """Many are equal: each distinct one, and which one it is."""
    values, place = np.unique(lp, return_inverse=True)
    return len(values).to_bytes(8, "little") + values.tobytes() + by_bytes(place.astype(np.uint32))


def chances_from_blob(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob, float, n, 8)[numbers(whole(blob[8 * (n + 1) :]), np.uint32)]


def dealt(keys: np.ndarray, n: np.ndarray, part: np.ndarray, to_blob) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, the block's distinct keys in it in order, how often each is in its training documents)."""
    order = np.argsort(part, kind="stable")
    keys, n, part = keys[order], n[order], part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(at, [*at[1:], len(part)], strict=False):
        yield int(part[a]), to_blob(keys[a:b]), by_bytes(n[a:b])


def words_from_blob(blob: bytes) -> np.ndarray:
    return numbers(whole(blob), U)


class Sums:
    """Counts by key, added up as they come, so that no more is held than what is distinct."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys), self.counts.append(counts)
        if len(self.keys) >= 8:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = summed(self.keys, self.counts)
        self.keys, self.counts, self.size = [k], [c], len(k)
        return k, c


def answered(asks: DataFrame, below: Trie, every: int, parts: int) -> DataFrame:
    """block, part, blob, n: for each block and part the n-grams asked for (blob) and their log10 probabilities (n); of parts from `parts` on,
    words and the log10 of their smoothed counts. Counts of all blocks are summed first."""
    shared, keep = asks.sparkSession.sparkContext.broadcast(below), KEEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, sums: Sums, asking: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            g, n = sums.done()
            seen, read = n > 0, from_blob(part)
            lp = levels(g[seen], n[seen], range(DEALT, ORDER + 1), every, keep, shared.value).score(g) if part < parts else np.where(seen, np.log10(n + 0.1), UNSEEN)
            for block, keys in asking:
                chances = chances_to_blob(lp[np.searchsorted(g, read(keys))])
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([keys], pa.binary()), pa.array([chances], pa.binary())], names=["block", "part", "blob", "n"])

        def from_blob(part: int):
            return grams_from_blob if part < parts else words_from_blob

        now, sums, asking = -1, Sums(), []
        for batch in batches:
            for block, part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and asking:
                    yield from out(now, sums, asking)
                    sums, asking = Sums(), []
                now = part
                sums.add(from_blob(part)(keys), numbers(whole(n), np.int64))
                asking.append((block, keys))
        if asking:
            yield from out(now, sums, asking)

    return asks.repartition(2 * parts, "part").sortWithinPartitions("part").mapInArrow(run, "block long, part int, blob binary, n binary")


def added(texts: DataFrame, answers: DataFrame, parts: int, heavy, floor: float) -> DataFrame:
    """row, n_tokens, n_known, base_score, score: each document's. Of a block, what the parts answered comes first, then its texts, a few at a time.
    heavy: the frequent words' hashes and counts, broadcast; floor: the log10 of what smoothed counts are divided by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = heavy.value
        frequent, logs, hashes = Table(keys), np.log10(counts + 0.1), word_hashes()
        now, ready = -1, False
        for batch in batches:
            for block, row, part, blob, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, ready = block, False
                    held = {GRAM: ([np.zeros(0, U)], [np.zeros(0)]), WORD: ([np.zeros(0, U)], [np.zeros(0)])}
                if row is None:
                    kind, read = (GRAM, grams_from_blob) if part < parts else (WORD, words_from_blob)
                    held[kind][0].append(read(blob)), held[kind][1].append(chances_from_blob(n))
                    continue
                if not ready:
                    (table, lp), (rare, rare_logs) = ((Table(np.concatenate(k)), np.concatenate(x)) for k, x in (held[GRAM], held[WORD]))
                    held, ready = {}, True
                docs = unpacked(blob)
                g, ends = grams(docs)
                score = np.add.reduceat(lp[table.at(g)], ends[:-1])
                h, sizes = words(docs, hashes)
                place = frequent.at(h)
                value = np.where(place >= 0, logs[place] if len(logs) else 0.0, UNSEEN)
                rest = np.flatnonzero(place < 0)
                if len(rare_logs):
                    value[rest] = rare_logs[rare.at(h[rest])]
                begins = np.cumsum(sizes) - sizes
                known, base = np.add.reduceat((value != UNSEEN).astype(np.int64), begins), np.add.reduceat(value, begins) - sizes * floor
                yield pa.record_batch([pa.array(np.arange(row, row + len(docs))), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names=names)

    names = ["row", "n_tokens", "n_known", "base_score", "score"]
    both = texts.unionByName(answers.withColumn("row", F.lit(None).cast("long"))).select("block", "row", "part", "blob", "n")
    both = both.repartition(parts, "block").sortWithinPartitions("block", F.col("row").asc_nulls_first(), "part")
    return both.mapInArrow(run, "row long, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training rows are those whose crc32(id as text) mod 10 is not 0 (a null id trains). Texts are lower-cased A-Z, null ones are empty and
    have one token, the end. Repeated rows count as often as they are there. Without training rows, no token is known, every symbol is
    equally likely, and the base score is 0. Empty table: no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, 10, 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = cut(count(rows.where("not held_out")))
    own = counted.where(F.col("kind") == WORD)
    n, v = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = own.where(F.col("n") * HEAVY > n).select("key", "n").toPandas()  # fewer than HEAVY
    floor = float(np.log10(n + 0.1 * (v + 1))) if n else 0.0
    every = counted.where(F.col("kind") == GRAM).agg(F.sum("n")).first()[0] or 0
    parts = every // PART + 1
    heavy = docs.sparkSession.sparkContext.broadcast((frequent["key"].to_numpy(np.int64).view(U), frequent["n"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, hashes, row = Table(heavy.value[0]), word_hashes(), TaskContext.get().partitionId() << 40

        def record(kind: int, rows: list[pa.Array], block: int | None = None, part: int | None = None, blob: bytes | None = None, n: bytes | None = None) -> pa.RecordBatch:
            each = ((kind, pa.int32()), (block, pa.int64()), (part, pa.int32()), (blob, pa.binary()), (n, pa.binary()))
            return pa.record_batch([*rows, *(pa.array([x] * len(rows[0]), t) for x, t in each)], names=names)

        def asks(block: int) -> Iterator[pa.RecordBatch]:
            (g, c), (w, d) = grams_.done(), words_.done()
            for part, blob, n in dealt(g, c, part_of(g, parts), grams_to_blob):
                yield record(ASK, nothing, block, part, blob, n)
            for part, blob, n in dealt(w, d, (parts + (mixed(w) % U(parts)).astype(np.int64)).astype(np.int32), by_bytes):
                yield record(ASK, nothing, block, part, blob, n)

        block, grams_, words_, size, nothing = row, Sums(), Sums(), 0, []
        for batch in batches:
            texts, done = [t.translate(LOWER) for t in batch.column(2).to_pylist()], 0
            empty = [pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.bool_())]
            nothing = [pa.nulls(1, pa.int64()), *empty]
            for part in chunks(texts):
                ids, held = batch.column(0).slice(done, len(part)), batch.column(1).slice(done, len(part))
                done += len(part)
                yield record(DOCUMENT, [pa.array(np.arange(row, row + len(part))), ids, held])
                yield record(TEXT, [pa.array([row], pa.int64()), *empty], block, -1, packed(part))
                trains = ~held.to_numpy(False).astype(bool)
                h, sizes = words(part, hashes)
                rare, g = table.at(h) < 0, grams(part)[0]
                for sums, keys, counts in ((grams_, g, np.repeat(trains, [len(t) + 1 for t in part])), (words_, h[rare], np.repeat(trains, sizes)[rare])):
                    for x, times in ((keys[counts], 1), (keys[~counts], 0)):
                        k, c = np.unique(x, return_counts=True)
                        sums.add(k, c * times)
                row += len(part)
                size += len(g)
                if size >= BLOCK or grams_.size + words_.size >= HELD:
                    yield from asks(block)
                    block, grams_, words_, size = row, Sums(), Sums(), 0
        if size:
            yield from asks(block)

    names = ["row", "id", "held_out", "kind", "block", "part", "blob", "n"]
    kind = docs.schema[id_col].dataType.simpleString()
    both = cut(rows.mapInArrow(run, f"row long, id {kind}, held_out boolean, kind int, block long, part int, blob binary, n binary"))
    known, asks, texts = (both.where(F.col("kind") == k) for k in (DOCUMENT, ASK, TEXT))
    score = added(texts.select("row", "block", "part", "blob", "n"), answered(asks.select("block", "part", "blob", "n"), short(counted, every), every, parts), parts, heavy, floor)
    return known.select("row", "id", "held_out").join(score, "row").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).alias("train_tokens"), ("base_score" if n else F.lit(0.0).alias("base_score")), "score"
    )
