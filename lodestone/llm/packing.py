"""Token-id output: documents as packed rows of ids, by best-fit-decreasing packing with a segment tree over capacities.

A document longer than a row is split without loss into full rows and a rest; the segments of a block of documents, longest
first, each go to the open row with the least room that holds them. Rooms are at most `row` tokens, so a segment tree
counts the open rows by room, and the best fit is the leftmost filled leaf from the segment's length on.

Blocks are BLOCK tokens of one partition, so memory is bounded and nothing is shuffled; each leaves a few half-filled rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker

ROW, BLOCK = 2048, 1 << 21
#: Packed ids and positions are 16-bit.
IDS = 1 << 16


class RoomTree:
    """Open rows by room, 0 to capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row with the least room of need or more, and its room."""
        counts, node = self.counts, self.leaves + need
        if not counts[node]:
            while node & 1 or not counts[node ^ 1]:  # up, until a right neighbour has rows
                node >>= 1
                if node <= 1:
                    return None
            node ^= 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            counts[node] -= 1
            node >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into sizes (each 1 to capacity). Equal sizes are placed in the order given."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        row, room = found or (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= IDS:
        raise ValueError(f"{path} has ids beyond {IDS - 1}, which packed rows can't hold")
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


SCHEMA = pa.schema([
    ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
])


def pack(docs: DataFrame, row: int = ROW, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A row per packed row of `row` tokens:

    pack_id, n_tokens (the rest of the row is end_id), ids (row little-endian uint16), cu_seqlens (where segments
    begin, then n_tokens), positions (row little-endian uint16: each token's place in its segment, so it is 0 where one begins),
    doc_ids and doc_offsets (each segment's document, and its first token's place in that document).

    Every document ends with end_id; a null or empty text is that one token. Documents longer than a row are split; none
    is cut short: `unpack` gives all back. Repeated rows and null ids are packed like others. Empty table: no rows. Ids beyond
    65,535, in the vocabulary or as end_id, and rows of more than 65,536 tokens are refused. Document ids are integers.
    """
    if not 0 <= end_id < IDS or not 1 <= row <= IDS:
        raise ValueError(f"end_id has to be below {IDS}, and a row 1 to {IDS} tokens")
    path = vocabulary or vocabulary_path()

    def flush(held: list[tuple[int | None, np.ndarray]], first: int) -> pa.RecordBatch:
        segments = [(d, at, ids[at : at + row]) for d, ids in held for at in range(0, len(ids), row)]
        packs = best_fit_decreasing([len(s[2]) for s in segments], row)
        matrix, places = np.full((len(packs), row), end_id, "<u2"), np.zeros((len(packs), row), "<u2")
        bounds, owners, offsets = [], [], []
        for k, members in enumerate(packs):
            parts = [segments[i] for i in members]
            cuts = np.cumsum([0, *(len(p[2]) for p in parts)])
            matrix[k, : cuts[-1]] = np.concatenate([p[2] for p in parts])
            places[k, : cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
            bounds.append(cuts)
            owners.append([p[0] for p in parts])
            offsets.append([p[1] for p in parts])
        return pa.record_batch([
            pa.array(range(first, first + len(packs)), pa.int64()), pa.array([int(c[-1]) for c in bounds], pa.int32()), pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array(bounds, pa.list_(pa.int32())),
            pa.array([p.tobytes() for p in places], pa.binary()), pa.array(owners, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64())),
        ], schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = in_worker(("tokenizer", path), lambda: tokenizer(path)).encode_to_numpy, np.array([end_id], np.uint16)
        first, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text, disallowed_special=()).astype(np.uint16), end])
                held.append((d, ids))
                size += len(ids)
                if size >= BLOCK:
                    out = flush(held, first)
                    first, held, size = first + out.num_rows, [], 0
                    yield out
        if held:
            yield flush(held, first)

    schema = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_offsets array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, doc_offset and ids (binary, uint16) of every segment of pack()'s rows."""
    each = packed.select(
        "ids", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("b"))).alias("_", "s")
    )
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_offsets").alias("doc_offset"), F.expr("substring(ids, 2 * s.a + 1, 2 * (s.b - s.a))").alias("ids"))
