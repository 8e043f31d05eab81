"""Language ID by segmentation-marginalised unigrams.

The model gives each language a probability for every piece of a fixed public vocabulary; a word's probability is the sum, over
all ways to cut it into pieces, of the product of theirs, computed by a forward pass. A text's score sums its words' logarithms.
Pieces don't cross words, so a word's scores are computed once and remembered.

Training is one pass of expectation: from pieces of equal probability, a forward and a backward pass give each piece's expected
count in every word of the labelled documents, all of them. Counts are summed by language and piece in Spark; the model is a table of
the vocabulary's size for each language, whatever the input.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import cut, in_worker
from .tables import Table

#: Words remembered by a Python worker, and the bytes of their table: with more languages, fewer words.
WORDS, TABLE_BYTES = 200_000, 1 << 27
SMOOTH = 0.05
#: Characters of a word that are looked up at once; steps after which sums over segmentations are scaled anew, so that neither long
#: words nor small probabilities leave what a double can hold.
STEP, SCALE = 2048, 16


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def pieces(path: str) -> dict[str, int]:
    """All pieces of letters and combining marks, with or without the mark of a word's beginning."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    found = sorted({p.lower() for p in plain if letters().fullmatch(p.strip("▁"))})
    return {p: i for i, p in enumerate(found)}


class Lattice:
    """Segmentations of many words at once. Any single character outside the vocabulary is a piece of its own, the
    unknown one, whose id is that after the last."""

    def __init__(self, path: str):
        found = pieces(path)
        self.unknown, self.longest = len(found), max(map(len, found), default=1)
        keys = np.zeros(len(found), np.uint64)
        for size in range(1, self.longest + 1):
            group = [p for p in found if len(p) == size]
            if group:
                keys[[found[p] for p in group]] = self.hashes(self.characters(group), size)[-1][:, 0]
        self.table = Table(keys)

    @staticmethod
    def characters(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)

    @staticmethod
    def hashes(c: np.ndarray, longest: int) -> list[np.ndarray]:
        """For each size up to the longest the hashes of all substrings, by word and where they begin."""
        own = c * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
        out = [own]
        for size in range(2, min(longest, c.shape[1]) + 1):
            out.append(out[-1][:, :-1] * np.uint64(0x9E3779B97F4A7C15) + own[:, size - 1 :])
        return out

    def edges(self, c: np.ndarray, begin: int, end: int) -> np.ndarray:
        """[word, end, length - 1] -> the id of the piece that ends there, -1 where there is none, for ends from begin up to end.
        c: the characters of words of one length."""
        from_ = max(0, begin - self.longest + 1)
        part = c[:, from_:end]
        out = np.full((*part.shape, min(self.longest, end)), -1, np.int32)
        for k, h in enumerate(self.hashes(part, self.longest)):
            out[:, k:, k] = self.table.at(h.ravel()).reshape(h.shape)
        out[:, :, 0][out[:, :, 0] < 0] = self.unknown
        return out[:, begin - from_ :]

    def forward(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The log-probability of each word by language, summed over all of its segmentations, whatever its length. c: characters of words of
        one length; p: by piece and language, with a last row of zeros."""
        m, n = c.shape
        f, log = [np.ones((m, p.shape[1]))], 0.0  # f: the probabilities of the beginnings that a piece can still follow, over exp(log)
        for begin in range(0, n, STEP):
            edges = self.edges(c, begin, min(n, begin + STEP))
            for at in range(edges.shape[1]):
                f.append(sum(f[-1 - size] * p[edges[:, at, size]] for size in range(min(len(f), edges.shape[2]))))
                if len(f) > self.longest:
                    del f[0]
                if (begin + at) % SCALE == SCALE - 1:
                    last = f[-1].copy()
                    f, log = [x / last for x in f], log + np.log(last)
        return log + np.log(f[-1])

    def expected(self, c: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, piece, expected count), a few characters at a time, under one language's p (by piece, with a last zero)."""
        m, n = c.shape
        f, log = np.empty((n + 1, m)), np.zeros((n + 1, m))  # of the beginnings: the probability is f * exp(log)
        f[0] = 1.0
        parts = [(b, min(n, b + STEP)) for b in range(0, n, STEP)]
        edges = None
        for begin, end in parts:
            edges = self.edges(c, begin, end)
            for at in range(begin, end):
                sizes = range(min(at + 1, edges.shape[2]))
                low = max(0, at - edges.shape[2] + 1)
                scaled = f[low : at + 1] if not n > SCALE else f[low : at + 1] * np.exp(log[low : at + 1] - log[at])
                f[at + 1] = sum(scaled[at - low - size] * p[edges[:, at - begin, size]] for size in sizes)
                log[at + 1] = log[at]
                if at % SCALE == SCALE - 1:
                    log[at + 1] += np.log(f[at + 1])
                    f[at + 1] = 1.0
        whole, back, back_log = log[n] + np.log(f[n]), [np.ones(m)], np.zeros(m)  # back: of the endings from here on, over exp(back_log)
        for begin, end in reversed(parts):
            edges = edges if end == n else self.edges(c, begin, end)
            ahead = edges if end == n else np.concatenate([edges, self.edges(c, end, min(n, end + self.longest))], 1)
            for at in range(end - 1, begin - 1, -1):
                # pieces that begin at `at`; back[k] is of the ending from at + 1 + k
                found = [(size, ahead[:, at - begin + size, size]) for size in range(min(len(back), ahead.shape[2], n - at)) if at - begin + size < ahead.shape[1]]
                ratio = f[at] * np.exp(log[at] + back_log - whole)
                total = 0.0
                for size, piece in found:
                    each = p[piece] * back[size]
                    total = total + each
                    hit = np.flatnonzero(piece >= 0)
                    if len(hit):
                        yield hit, piece[hit], (ratio * each)[hit]
                back = [total, *back[: self.longest - 1]]
                if at % SCALE == 0:
                    back, back_log = [x / total for x in back], back_log + np.log(total)


@functools.cache
def letters():
    import regex

    return regex.compile(r"[\p{L}\p{M}]+")


def words_of(text: str) -> list[str]:
    """A text's words, lower-cased: its runs of letters and combining marks that have a letter."""
    return [w for w in letters().findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def by_length(words: list[str], longest: int) -> Iterator[list[str]]:
    """Groups of words of one length, of bounded size."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, group in groups.items():
        step = max(1, 200_000 // (min(n, STEP) * longest))
        yield from (group[i : i + step] for i in range(0, len(group), step))


def train(docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """lang, piece, n: the pieces' expected counts in the rows that `where` holds for, over all of them. Null texts and languages are left out."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = in_worker(("lattice", path), lambda: Lattice(path))
        size = lattice.unknown + 1
        p = np.append(np.full(size, 1.0 / size), 0.0)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            place: dict[str, int] = {}
            rows = []
            for lang, words in counts.items():
                rows += [(place.setdefault("▁" + word, len(place)), lang, n) for word, n in words.items()]
            if not rows:
                continue
            langs = sorted({r[1] for r in rows})
            number = {x: i for i, x in enumerate(langs)}
            weight = np.zeros((len(place), len(langs)))
            np.add.at(weight, (np.array([r[0] for r in rows]), np.array([number[r[1]] for r in rows])), np.array([float(r[2]) for r in rows]))
            sums = np.zeros((size, len(langs)))
            for group in by_length(list(place), lattice.longest):
                own, held = weight[[place[x] for x in group]], []
                for found in itertools.chain(lattice.expected(lattice.characters(group), p), [None]):
                    if found:
                        held.append(found)
                    if held and (found is None or len(held) >= 4096):
                        word, piece, n = (np.concatenate(x) for x in zip(*held, strict=True))
                        w, held = own[word] * n[:, None], []
                        for k in range(len(langs)):
                            sums[:, k] += np.bincount(piece, w[:, k], size)
            for k, lang in enumerate(langs):
                total[lang] = total.get(lang, 0) + sums[:, k]
        for lang, n in total.items():
            hit = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(hit)), pa.array(hit, pa.int32()), pa.array(n[hit])], names=["lang", "piece", "n"])

    rows = docs.where(where & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Scorer:
    """Words' log-probabilities by language, remembered."""

    def __init__(self, path: str, p: np.ndarray):
        self.lattice, self.p = Lattice(path), p
        self.most = max(1000, min(WORDS, TABLE_BYTES // (8 * max(1, p.shape[1]))))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 16, self.p.shape[1]))

    def learn(self, words: set[str]) -> None:
        at = len(self.place)
        while at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for group in by_length(["▁" + w for w in words], self.lattice.longest):
            self.table[at : at + len(group)] = self.lattice.forward(self.lattice.characters(group), self.p)
            self.place.update((w[1:], at + k) for k, w in enumerate(group))
            at += len(group)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language the log-probability; each text's number of words."""
        split = [words_of(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.place}
        if len(self.place) + len(new) > self.most and self.place:
            self.forget()
            new = {w for words in split for w in words}
        if new:
            self.learn(new)
        sizes = np.array([len(w) for w in split])
        found = self.table[np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(split)), np.int64, sizes.sum())]
        sums = np.concatenate([np.zeros((1, self.p.shape[1])), np.cumsum(found, 0)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes], sizes


def labeller(docs: DataFrame, model: DataFrame, path: str) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    """What tells texts' languages and scores, in a task: the likeliest language (ties: the first by name) and its probability among them if all were as frequent. Null texts and texts
    without a letter, or a model without languages: und, 0."""
    table = model.toPandas()  # at most the vocabulary's size for each language
    langs = sorted(table["lang"].unique())
    size = len(pieces(path)) + 1
    counts = np.zeros((size, len(langs)))
    counts[table["piece"].to_numpy(int), table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = table["n"]
    p = np.concatenate([(counts + SMOOTH) / (counts + SMOOTH).sum(0), np.zeros((1, len(langs)))]) if langs else np.zeros((size + 1, 0))
    shared, key = docs.sparkSession.sparkContext.broadcast(p), uuid.uuid4().hex

    def label(texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        score, words = in_worker(key, lambda: Scorer(path, shared.value)).score(texts)
        top = score.argmax(1)
        odds = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        return [langs[i] if ok else "und" for i, ok in zip(top, words, strict=True)], [float(x) if ok else 0.0 for x, ok in zip(odds, words, strict=True)]

    return label


#: Texts that are labelled at once.
AT_ONCE = 500


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, lang_pred, score of every row, as `labeller` says."""
    label = labeller(docs, model, vocabulary or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                best, share = label(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = StructField(id_col, docs.schema[id_col].dataType)
    return docs.select(id_col, text_col).mapInArrow(run, StructType([kind, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row's id falls into the held-out part; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """id, held_out, lang_pred, score of every row, learnt from the rows of docs that aren't held out. Rows that repeat count
    as often as they are there. Empty table: no rows. Other columns are not looked at."""
    model = cut(train(docs, ~held_out(id_col), text_col, lang_col, vocabulary))
    return predict(docs, model, id_col, text_col, vocabulary).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """docs without the rows in which no language is found (null, empty or letterless texts); columns unchanged, whatever their names; predictions not kept. Repeated rows stay or go together. Empty table: no rows."""
    path = vocabulary or vocabulary_path()
    label = labeller(docs, cut(train(docs, ~held_out(id_col), text_col, lang_col, path)), path)

    @F.arrow_udf("string")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # only texts go to Python, not whole rows
        for batch in batches:
            yield pa.array([x for i in range(0, len(batch), AT_ONCE) for x in label(batch.slice(i, AT_ONCE).to_pylist())[0]], pa.string())

    return docs.where(language(F.col(text_col)) != "und")
