"""Near-duplicates by SimHash, found by the generalised pigeonhole principle.

A text's fingerprint has a bit for each of 64: whether it is set in over half of the hashes of its shingles. Fingerprints of at most LIMIT differing bits are linked.

The bits are grouped into PARTS partitions, those that go together over all fingerprints in one. If a fingerprint's thresholds t of the partitions have
sum(t + 1) = LIMIT + 1 (-1: a partition isn't asked), every fingerprint within LIMIT differs from it by no more than t in some partition. How many
fingerprints lie within t of a value is known for every value of a partition: a histogram of its 2 ** 16 values, spread over its bits. So each fingerprint gets
the thresholds, unequal as they may be, of the least estimated number of candidates, by dynamic programming over the partitions. It probes the index (each fingerprint under each of
its partitions' values) with all values within its thresholds, and what it meets is verified on all 64 bits, within the join.

Texts of equal fingerprints are one node. Thousands of copies that are almost the same meet in every partition; to keep their pairs from growing with the square of
their number, each node first meets only a few leaders of the values it probes, and what is linked is merged. Then nodes are joined only where their components differ,
a value's main component on one side at most, so that nothing within a component is paired and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, reshuffled
from .shingles import LOWER

WIDTH, LIMIT, SEED = 4, 4, 42
PARTS, BITS = 4, 16
#: Leaders of a value besides the one with most company.
LEADERS = 3
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a text, A-Z lower-cased, by shingles of `width` words that ASCII white space parts, repeats included; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(width, len(words))
    n = len(words) - w + 1
    one, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        h = np.fromiter((one(line[a:b], SEED) for a, b in zip(starts[i:j].tolist(), ends[i + w - 1 : j + w - 1].tolist(), strict=True)), np.uint64, j - i)
        ones += bits_of(h).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def bits_of(x: np.ndarray) -> np.ndarray:
    """64 columns, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(x).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, fp (a signed long) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or b"", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


def together(fps: DataFrame) -> np.ndarray:
    """How often each two bits are set in the same fingerprint; each bit's own number on the diagonal. Summed in tasks: 4,096 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), BLOCK):
                b = bits_of(x[i : i + BLOCK].view(np.uint64)).astype(np.float32)
                both += (b.T @ b).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(4096)), pa.array(both.ravel())], names=["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4096, np.int64)
    for cell, n in cells:
        out[cell] = n
    return out.reshape(64, 64)


def partitions(both: np.ndarray, n: int) -> list[list[int]]:
    """The bits in PARTS groups of BITS: the two bits that go together most begin one, and the bit that goes best with those it has is added till it is full."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(alike, 0)
    free, out = list(range(64)), []
    for _ in range(PARTS):
        sub = alike[np.ix_(free, free)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [free[i], free[j]] if i != j else free[:2]
        while len(group) < BITS:
            group.append(max((b for b in free if b not in group), key=lambda b: (alike[b, group].mean(), -b)))
        out.append(sorted(group))
        free = [b for b in free if b not in group]
    return out


def part_value(fp: Column, bits: list[int]) -> Column:
    value = F.lit(0).cast("long")
    for place, bit in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftright(fp, bit).bitwiseAND(F.lit(1)), place))
    return value


def histograms(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """The number of fingerprints by partition and value: at most PARTS * 2 ** BITS rows come to the driver."""
    each = fps.select(F.explode(F.array(*[(F.lit(i << BITS).cast("long") + part_value(F.col("fp"), g)) for i, g in enumerate(groups)])).alias("key"))
    t = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(PARTS << BITS, np.int64)
    out[t.column("key").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(PARTS, 1 << BITS)


def within(histogram: np.ndarray, limit: int) -> np.ndarray:
    """How many fingerprints lie within 0 to limit bits of each value of a partition, exactly: each bit in turn may differ or not."""
    at = np.zeros((limit + 1, len(histogram)))
    at[0] = histogram
    v = np.arange(len(histogram))
    for bit in range(BITS):
        other = at[:, v ^ (1 << bit)]
        at[1:] += other[:-1]
    return np.cumsum(at, 0)


def masks(limit: int) -> list[np.ndarray]:
    """The masks of at most t bits of a partition, by t."""
    ones = np.array([v.bit_count() for v in range(1 << BITS)])
    return [np.flatnonzero(ones <= t) for t in range(limit + 1)]


def thresholds(values: np.ndarray, near: np.ndarray, limit: int) -> np.ndarray:
    """The thresholds of each row of partition values, with sum(t + 1) = limit + 1 and the least candidates and probes. near: partition, t, value."""
    parts, n = len(near), len(values)
    probes = np.cumsum([math.comb(BITS, t) for t in range(limit + 1)])
    best = np.full((n, limit + 2), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, n, limit + 2), np.int8)
    for i in range(parts):
        cost = np.concatenate([np.zeros((n, 1)), near[i][:, values[:, i]].T + probes], 1)  # of t + 1
        new = np.full_like(best, np.inf)
        for spent in range(limit + 2):
            for t1 in range(spent + 1):
                c = best[:, spent - t1] + cost[:, t1]
                better = c < new[:, spent]
                new[better, spent] = c[better]
                chosen[i, better, spent] = t1
        best = new
    out, spent = np.zeros((n, parts), np.int64), np.full(n, limit + 1)
    for i in reversed(range(parts)):
        t1 = chosen[i, np.arange(n), spent]
        out[:, i] = t1 - 1
        spent = spent - t1
    return out


def packed_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    bits = bits_of(fp.view(np.uint64)).astype(np.int64)
    return np.stack([bits[:, g] @ (1 << np.arange(BITS)) for g in groups], 1)


def probes_and_index(fps: DataFrame, groups: list[list[int]], counts: np.ndarray, limit: int) -> tuple[DataFrame, DataFrame]:
    """Probes (fp, key) and index entries (fp, key, company: how many fingerprints share its values)."""
    shared = fps.sparkSession.sparkContext.broadcast(counts)  # PARTS * 2 ** BITS numbers

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.stack([within(h, limit) for h in shared.value])
        by_t = masks(limit)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(begin, 4096).to_numpy(zero_copy_only=False)
                values = packed_values(fp, groups)
                t = thresholds(values, near, limit)
                for i in range(PARTS):
                    for k in range(limit + 1):
                        some = np.flatnonzero(t[:, i] == k)
                        step = max(1, 65536 // len(by_t[k]))
                        for at in range(0, len(some), step):
                            who = some[at : at + step]
                            keys = (values[who, i][:, None] ^ by_t[k]) + (i << BITS)
                            yield pa.record_batch([pa.array(np.repeat(fp[who], len(by_t[k]))), pa.array(keys.ravel())], names=["fp", "key"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            values = packed_values(fp, groups)
            company = sum(shared.value[i][values[:, i]] for i in range(PARTS))
            yield pa.record_batch([pa.array(np.repeat(fp, PARTS)), pa.array((values + (np.arange(PARTS) << BITS)).ravel()), pa.array(np.repeat(company, PARTS))], names=["fp", "key", "company"])

    slim = fps.select("fp")
    return slim.mapInArrow(probe, "fp long, key long"), slim.mapInArrow(entries, "fp long, key long, company long")


def linked(a: str, b: str, limit: int) -> Column:
    return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit)


def links(fps: DataFrame, same: DataFrame, limit: int = LIMIT) -> DataFrame:
    """node, component of the fingerprints (fp, distinct) that are linked with others; the component is its least fingerprint. same: pairs a, b that are linked besides."""
    n = fps.count()
    groups = partitions(together(fps), n)
    probes, index = probes_and_index(fps, groups, histograms(fps, groups), limit)
    probes, index = cut(probes), cut(index)

    leaders = index.groupBy("key").agg(F.max_by("fp", F.struct("company", "fp")).alias("l0"), *[F.max_by("fp", F.xxhash64("fp", F.lit(i))).alias(f"l{i}") for i in range(1, LEADERS + 1)])
    leaders = cut(leaders)
    met = probes.join(reshuffled(leaders.withColumnRenamed("key", "_key"), "_key"), F.col("key") == F.col("_key"))
    near = F.filter(F.array(*[f"l{i}" for i in range(LEADERS + 1)]), lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= limit))
    stars = met.select("fp", near.alias("near")).where("size(near) > 0").select("fp", F.explode(F.array_distinct("near")).alias("l"))
    first = cut(components(stars.select(F.col("fp").alias("a"), F.col("l").alias("b")).union(same)))

    of = reshuffled(first, "node")
    placed = lambda df: df.join(of, F.col("fp") == F.col("node"), "left").select("fp", "key", F.coalesce("component", "fp").alias("own"))
    main = leaders.join(of, F.col("l0") == F.col("node"), "left").select(F.col("key").alias("_key"), F.coalesce("component", "l0").alias("main"))
    with_main = lambda df: df.join(reshuffled(main, "_key"), F.col("key") == F.col("_key")).select("fp", "key", "own", "main")
    asks, has = cut(with_main(placed(probes))), cut(with_main(placed(index.select("fp", "key"))))
    other = has.select(F.col("fp").alias("y"), F.col("key").alias("_key"), F.col("own").alias("y_own"), F.col("main").alias("y_main"))

    def across(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, (F.col("key") == F.col("_key")) & (F.col("own") != F.col("y_own")) & linked("fp", "y", limit)).select(F.col("fp").alias("a"), F.col("y").alias("b"))

    new = across(asks.where("own != main"), other).union(across(asks.where("own = main"), other.where("y_own != y_main")))
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(cut(new)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """A row per row of docs: id, fingerprint (16 hex digits), component_id (the least id it is linked with over any number of links, itself included).

    A null or wordless text has the fingerprint 0, and is linked like any other. Rows with one id are one document, which has the links of each. A null id has its
    component's least id, or none. Empty table: no rows. Other columns are not looked at. Ids are integers.
    """
    signed = cut(sign(docs, id_col, text_col, width))
    fps = cut(signed.groupBy("fp").agg(F.min("id").alias("least")))
    ids = signed.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z").select("id", "a")
    same = signed.join(ids, "id").where("fp != a").select("a", F.col("fp").alias("b")).distinct()
    found = cut(links(fps, same, limit))
    placed = cut(fps.join(reshuffled(found, "node"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(reshuffled(smallest.withColumnRenamed("component", "_c"), "_c"), F.col("component") == F.col("_c")).select(F.col("fp").alias("_fp"), "component_id")
    out = signed.join(reshuffled(named, "_fp"), F.col("fp") == F.col("_fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
