"""Hard negatives by block matrix multiplication in two dimensions, as in SUMMA.

Rows are cut into shards of ROWS vectors of one label, anchors into shards of ANCHORS, and both into panels of DIMS dimensions. Shards are dealt over a grid: those of the
anchors go to all cells of a grid row, those of the rows to all cells of a grid column, so that each pair meets in one cell. There its tile of scores, int64 and exact, is added up
panel by panel, SLICE anchors at a time, and stays: only the best rows of each anchor's windows leave the cell.

Same-label tiles give the positives, tiles of different labels the negatives in the windows that the positives' scores set: each score is worked out once. No task works on
more than two shards and a tile at once, whatever the sizes of labels; the work is anchors times rows, which an exact search over all rows is, but what is shuffled is the shards, once
for each grid column or row, and the best rows of each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROWS, ANCHORS, SLICE, DIMS = 2048, 1024, 256, 32
#: Bytes of a shard; very wide vectors get shorter ones.
BYTES = 1 << 25
#: Shards of rows in a cell, which a join holds; found rows that a task holds before it drops all but the best.
CELL, HELD = 8, 1 << 18
LEAST, MOST = -(1 << 63), (1 << 63) - 1

SHARD = "label long, shard long, uids array<long>, ids array<long>, windows array<array<long>>, panels array<binary>"
FOUND = "uid long, slot long, b_uid long, b_id long, score long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label, vector (longs: floor(scale * x), x as double) of the rows that have a label and a whole, finite vector."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    whole = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector")).where("label is not null and vector is not null")
    return whole.where(finite).select("id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def shards(rows: DataFrame, size: int) -> DataFrame:
    """Shards of rows (label, uid, id, vector, windows), which are in order of label within their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = used = made = 0
        label = None

        def close() -> pa.RecordBatch:
            nonlocal held, n, used, made
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: t.column(name).combine_chunks()
            vectors = column("vector")
            width = max(1, int(vectors.value_lengths().to_numpy(zero_copy_only=False).max()))
            m = dense(vectors, width)
            panels = [np.ascontiguousarray(m[:, k * DIMS : (k + 1) * DIMS]).tobytes() for k in range(-(-width // DIMS))]
            shard = TaskContext.get().partitionId() << 32 | made
            one = lambda a, kind: pa.array([a.to_pylist()], kind)
            longs = pa.list_(pa.int64())
            out = pa.record_batch(
                [pa.array([label], pa.int64()), pa.array([shard], pa.int64()), one(column("uid"), longs), one(column("id"), longs), one(column("windows"), pa.list_(longs)), pa.array([panels], pa.list_(pa.binary()))],
                names=["label", "shard", "uids", "ids", "windows", "panels"],
            )
            held, n, used, made = [], 0, 0, made + 1
            return out

        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            widths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(labels):
                if n and labels[at] != label:
                    yield close()
                label = int(labels[at])
                room = min(size - n, len(labels) - at)
                same = np.flatnonzero(labels[at : at + room] != label)
                take = int(same[0]) if len(same) else room
                over = np.flatnonzero(used + 8 * np.cumsum(widths[at : at + take]) > BYTES)
                take = max(1, int(over[0])) if len(over) else take
                held.append(batch.slice(at, take))
                n, used, at = n + take, used + 8 * int(widths[at : at + take].sum()), at + take
                if n >= size or used >= BYTES:
                    yield close()
        if n:
            yield close()

    return rows.select("label", "uid", "id", "vector", "windows").mapInArrow(run, SHARD)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, in int64; by doubles where they hold all sums exactly."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def tile(a: list[np.ndarray], b: list[np.ndarray], some: slice) -> np.ndarray:
    """Scores of some anchors with all rows of a shard, added up panel by panel; what a shorter vector lacks counts as 0."""
    scores = np.zeros((len(a[0][some]), len(b[0])), np.int64)
    for left, right in zip(a, b, strict=False):
        width = min(left.shape[1], right.shape[1])
        scores += product(left[some, :width], right[:, :width])
    return scores


def ranked(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of the tile its places by falling score, of equals the first, and the scores in this order, negated. Where a score and a place fit a number, numbers are sorted, which is faster."""
    bits = scores.shape[1].bit_length()
    if -1 << 62 - bits < scores.min(initial=0) and scores.max(initial=0) < 1 << 62 - bits:
        both = np.sort(-scores << bits | np.arange(scores.shape[1]), 1)
        return both & (1 << bits) - 1, both >> bits
    order = np.argsort(-scores, 1, kind="stable")
    return order, -np.take_along_axis(scores, order, 1)


def picked(scores: np.ndarray, own: np.ndarray, windows: list[np.ndarray], b_uids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Anchor, slot, row (by their places in the tile), score: of each anchor's windows the first k rows by score, then by id, but the anchor itself."""
    order, falling = ranked(scores)  # rows come by id
    who = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    slots, low, high = np.concatenate([np.empty((0, 3), np.int64), *windows]).T
    begin = np.concatenate([np.empty(0, np.int64), *(np.searchsorted(f, -w[:, 2], "left") for f, w in zip(falling, windows, strict=True))])
    places = begin[:, None] + np.arange(k + 1)
    inside = places < scores.shape[1]
    rows = order[who[:, None], np.minimum(places, scores.shape[1] - 1)]
    inside &= (scores[who[:, None], rows] >= low[:, None]) & (scores[who[:, None], rows] <= high[:, None]) & (b_uids[rows] != own[who][:, None])
    inside &= np.cumsum(inside, 1) <= k
    at, nth = np.nonzero(inside)
    return who[at], slots[at], rows[at, nth], scores[who[at], rows[at, nth]]


def first(found: list[np.ndarray], k: int) -> np.ndarray:
    """The first k of each uid and slot, by score, then id, null last. Columns: those of FOUND, then whether the id is null."""
    rows = np.concatenate(found, 1)
    uid, slot, b_uid, b_id, score, null = rows
    rows = rows[:, np.lexsort((b_uid, b_id, null, -score, slot, uid))]
    starts = np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]
    n = np.arange(rows.shape[1])
    return rows[:, n - np.maximum.accumulate(np.where(starts, n, 0)) < k]


def best_of(k: int):
    """Of each pair of shards' tile the first k rows of each anchor's windows; pairs of the same anchors that follow each other give them together."""

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        *columns, null = first(found, k)
        return pa.record_batch([pa.array(c, pa.int64(), mask=null > 0 if n == 3 else None) for n, c in enumerate(columns)], names=["uid", "slot", "b_uid", "b_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, 0, []
        for batch in batches:
            for i, anchors in enumerate(batch.column("a").to_pylist()):
                if found and anchors != now:
                    yield out(found)
                    held, found = 0, []
                now = anchors
                a_uids, b_uids, b_ids, windows = (batch.column(c)[i].values for c in ("a_uids", "b_uids", "b_ids", "windows"))
                own, b_uids, null = a_uids.to_numpy(), b_uids.to_numpy(), b_ids.is_null().to_numpy(zero_copy_only=False)
                ids = b_ids.fill_null(0).to_numpy()
                triples = np.split(windows.flatten().to_numpy().reshape(-1, 3), np.cumsum(windows.value_lengths().to_numpy() // 3)[:-1])
                a, b = ([np.frombuffer(p.as_buffer(), np.int64).reshape(n, -1) for p in batch.column(c)[i].values] for c, n in (("a_panels", len(own)), ("b_panels", len(b_uids))))
                for start in range(0, len(own), SLICE):
                    some = slice(start, start + SLICE)
                    who, slots, rows, scores = picked(tile(a, b, some), own[some], triples[some], b_uids, k)
                    if len(who):
                        found.append(np.stack([own[some][who], slots, b_uids[rows], ids[rows], scores, null[rows]]))
                        held += len(who)
                if held > HELD:
                    found = [first(found, k)]
                    held = found[0].shape[1]
        if found:
            yield out(found)

    return run


def grid(shards: int, partitions: int) -> tuple[int, int]:
    """Rows and columns of a grid of about so many cells, with few enough shards of rows in a column. Columns cost copies of the anchors, which are few, and of what they find;
    rows cost copies of the table."""
    tall = max(1, math.isqrt(partitions // 20))
    return tall, max(1, -(-shards // CELL), min(shards, partitions // tall))


def search(anchors: DataFrame, rows: DataFrame, same: bool, k: int, tall: int, wide: int) -> DataFrame:
    """uid, slot, b_uid, b_id, score, at: of each anchor's windows (slot, low, high) the first k rows of the same label, or of others, by score and then id. An anchor isn't
    found itself. anchors and rows: shards."""
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_of = lambda n: F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int")
    left = anchors.select("label", F.col("shard").alias("a"), F.col("uids").alias("a_uids"), "windows", F.col("panels").alias("a_panels"), one_of(tall).alias("row"), everywhere(wide).alias("col"))
    right = rows.select("label", F.col("uids").alias("b_uids"), F.col("ids").alias("b_ids"), F.col("panels").alias("b_panels"), one_of(wide).alias("col"), everywhere(tall).alias("row"))
    # Spark takes the copies of the anchors for no more than the anchors, and would broadcast them all: their join is told to be a merge. A task is a cell, as what it does isn't told by its bytes
    cell = ["row", "col", *["label"] * same]
    left, right = (side.repartition(tall * wide, *cell) for side in (left, right.withColumnRenamed("label", "label" if same else "b_label")))
    pairs = left.hint("merge").join(right, cell)
    if not same:
        pairs = pairs.where("label != b_label")
    found = pairs.select("a", "a_uids", "windows", "a_panels", "b_uids", "b_ids", "b_panels").mapInArrow(best_of(k), FOUND)
    at = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.col("b_id").asc_nulls_last(), "b_uid"))
    return found.withColumn("at", at).where(F.col("at") <= k)


def mine(rows: DataFrame, label: Column, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (its id is divisible by `every`) and each of its first `positives` other rows of the same label, the
    first `negatives` rows of other labels whose score is within `window` percents of the positive's.

    Scores are inner products of floor(scale * x), of at most 2 ** 56; the higher comes first, of equals the smaller id, null the last. Rows without a label, or whose vector is
    null or has a null or non-finite component, take no part. Vectors of several lengths: what is missing counts as 0. Rows that share an id are rows of
    their own. Empty table: no rows. Other columns are not looked at.
    """
    order = ["label", F.col("id").asc_nulls_last(), "_tie"]
    known = usable(rows, id_col, vector_col, label, scale).withColumn("_tie", F.monotonically_increasing_id())
    known = known.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "id", "vector", F.monotonically_increasing_id().alias("uid"))
    known = cut(known)
    none = F.array().cast("array<long>")
    all_ = cut(shards(known.withColumn("windows", none), ROWS))
    cells = grid(all_.count(), max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    chosen = known.where(F.col("id") % every == 0)

    def sharded(anchors: DataFrame) -> DataFrame:
        return shards(anchors.repartitionByRange("label", "uid").sortWithinPartitions("label", "uid"), ANCHORS)

    whole = F.array(F.lit(0), F.lit(LEAST + 1), F.lit(MOST)).cast("array<long>")
    best = cut(search(sharded(chosen.withColumn("windows", whole)), all_, True, positives, *cells).select("uid", F.col("at").cast("long").alias("slot"), F.col("b_id").alias("positive_id"), F.col("score").alias("positive_score")))
    low, high = F.expr(f"({window[0]} * positive_score + 99) div 100"), F.expr(f"({window[1]} * positive_score) div 100")
    sets = best.where("positive_score >= 0").groupBy("uid").agg(F.flatten(F.collect_list(F.array("slot", low, high))).alias("windows"))
    wanted = chosen.join(sets, "uid")
    found = search(sharded(wanted), all_, False, negatives, *cells)
    named = best.join(chosen.select("uid", F.col("id").alias("anchor_id")), "uid")
    return found.join(named, ["uid", "slot"]).select("anchor_id", "positive_id", F.col("at").cast("int").alias("rank"), F.col("b_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def moved(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, moved on by one of ten where the id is divisible by 7."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id, s.br) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
