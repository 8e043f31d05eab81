"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

Encoding a piece: an Aho-Corasick pass finds every vocabulary token in it. From the left, the longest token at a position
is taken if merging would leave it beside the token before it (the pair-compatibility table); else the next shorter one;
if none fits, the position is marked as a dead end and the token before it gives way. Each position fails at most once, so
the time is linear in the piece, and the result is that of merging by rank.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker

#: Fixed value: the pattern that splits text before the merges (public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONE_SPACE, ODD_SPACE = re.compile(r"(?<=\S) (?=\S)").split, re.compile(r"^ | $| \s|\s ").search
#: Pieces and words up to this length are remembered, twice CACHE of either at most, some 80 MB in all.
CACHE, CACHED_CHARS = 100_000, 48
PAIRS = 400_000
ROWS = 500


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """piece -> ids as bytes, of two generations of which the older is dropped."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.encode(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """A byte-level BPE vocabulary of the tokenizers library whose ids follow the merges' ranks."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = printable_bytes()
        vocab = {k.translate({ord(c): chr(b) for c, b in byte.items()}): i for k, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.split = [(i, i) for i in range(size)]
        self.merged: dict[int, int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ("".join(chr(byte[c]) for c in x) for x in (a, b))
            whole = vocab[a + b]
            self.split[whole] = vocab[a], vocab[b]
            self.merged[vocab[a] << 32 | vocab[b]] = whole
        self.vocab, self.lens = vocab, [0] * size
        self.trie = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.lens[i] = len(s)
            self.trie.add_word(s, (len(s) - 1, i))
        self.trie.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.marks = regex.compile("|".join(map(regex.escape, self.special))).findall if self.special else None
        self.pieces = Cache(self.piece)
        self.words = Cache(lambda word: b"".join(map(self.pieces.__getitem__, self.find(" " + word))))
        # the decoder's offset table: token i is blob[offset[i]:offset[i + 1]]
        raw = {i: s.encode("latin-1") for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(size)), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(raw.get(i, b"")) for i in range(size)])])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave these two tokens side by side: undo the merges of both, the latest first, and see
        whether a merge across the border would have come before."""
        key, least = left << 32 | right, 1 << 31
        a, b, split = left, right, self.split
        while True:
            if self.merged.get(a << 32 | b, least) < least:
                fits = False
                break
            if a > b:
                least, (_, part) = a, split[a]
                if part != a:
                    a = part
                    continue
                least, (part, _) = b + 1, split[b]
                if part == b:
                    fits = True
                    break
                b = part
            else:
                least, (part, _) = b + 1, split[b]
                if part != b:
                    b = part
                    continue
                least, (_, part) = a, split[a]
                if part == a:
                    fits = True
                    break
                a = part
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def piece(self, piece: str) -> bytes:
        """A pre-token's ids, as little-endian unsigned 32-bit integers."""
        s = piece.encode().decode("latin-1")
        if (whole := self.vocab.get(s)) is not None:
            return whole.to_bytes(4, "little")
        n, lens, pairs = len(s), self.lens, self.pairs
        at: list[list[int]] = [[] for _ in range(n + 1)]
        for end, (back, token) in self.trie.iter(s):
            at[end - back].append(token)  # shorter ones come first
        dead, out, tried, pos = bytearray(n + 1), [], [], 0
        i = len(at[0])
        while pos < n:
            here, last = at[pos], out[-1] if out else -1
            while i:
                i -= 1
                token = here[i]
                end = pos + lens[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
            else:
                dead[pos] = 1
                pos -= lens[out.pop()]
                i = tried.pop()
                continue
            out.append(token)
            tried.append(i)
            pos, i = end, len(at[end])
        return np.array(out, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens. A single space between other characters starts a piece whatever stands
        around it, so that the words it parts are encoded, and remembered, on their own."""
        first, *rest = text.split(" ") if ODD_SPACE(text) is None else LONE_SPACE(text)
        return b"".join([*map(self.pieces.__getitem__, self.find(first)), *map(self.words.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """A text's ids, as little-endian unsigned 32-bit integers. Special tokens' own strings count as those tokens."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        marks = [self.special[s].to_bytes(4, "little") for s in self.marks(text)]
        return b"".join(x for pair in zip([b"", *marks], map(self.plain, self.specials(text)), strict=True) for x in pair)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        i = np.frombuffer(ids, "<u4")
        start, size = self.offset[i], self.offset[i + 1] - self.offset[i]
        ends = np.cumsum(size)
        if not len(ends):
            return ""
        return self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return in_worker(("codec", path), lambda: Codec(path))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows."""
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A row per row of docs: id, n_tokens, ids (binary, little-endian unsigned 32-bit). A null text counts as empty: no ids.
    Whole texts of any length; other columns are not looked at; repeated rows stay. vocabulary: a path on every executor."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in parts(batches):
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """The rows of encode() with a text column beside. Null ids give an empty text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in parts(batches):
            texts = [c.decode(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """decode(encode(docs)): id, n_tokens, ids, text of every row, both ways in one pass of a Python worker, so that an executor holds the vocabulary once a task. A null text is empty and has no tokens; repeated rows and ids
    are rows of their own. Empty table: no rows. Other columns are not looked at."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in parts(batches):
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())],
                names=[id_col, "n_tokens", "ids", "text"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, text string")
