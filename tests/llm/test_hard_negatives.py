import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, slot string, vector string, id string, windows string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "u", "s", "v", "i", "w") for r in rows], SCHEMA)


def plain(rows):
    known = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        known.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(known):
        if i is None or i % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), late(j), n) for n, (j, w, _) in enumerate(known) if n != a]
        for s, _, n in sorted(x for x in scores if known[x[2]][2] == label)[:5]:
            found = [x for x in sorted(scores) if known[x[2]][2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, known[n][0], rank + 1, known[m][0], -s, -t) for rank, (t, _, m) in enumerate(found[:10])]
    return sorted(out, key=str)


def some(seed, n, dims, labels=4):
    r = random.Random(seed)
    ids = [100 * i if r.random() < 0.1 else i for i in range(n)]
    rows = [(i, [r.gauss(0.1, 0.3) for _ in range(dims)], r.randrange(labels)) for i in ids]
    return rows + [(i + 1, v, y) for i, v, y in rows[: n // 8]]


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 300, 5), (2, 200, 70), (3, 260, 33)])
def test_equals_comparing_all(spark, monkeypatch, seed, n, dims):
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "ANCHORS", 16)
    monkeypatch.setattr(H, "SLICE", 5)
    rows = some(seed, n, dims)
    got = H.mine(frame(spark, rows).repartition(5), H.moved())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_nulls_repeats_lengths_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25, -0.5]
    rows = [(100, v, 1), (100, v, 1), (1, v, 1), (2, [0.3, 0.2, -0.2], 2), (3, [0.3, 0.2, -0.2], 2), (None, [0.3, 0.2, -0.2], 2), (None, v, None), (4, None, 1), (5, [nan, 0.0, 0.0], 2), (6, [inf, 0.0, 0.0], 2), (8, [None, 1.0, 1.0], 1)]
    rows += [(9, [0.4], 1), (10, [0.4, 0.1, 0.0, 9.0, 9.0], 3), (11, [], 1), (200, [], 3), (300, [0.0], 3), (7, [0.3, 0.2, -0.2], 1)]
    got = sorted(map(tuple, H.mine(frame(spark, rows), H.moved()).collect()), key=str)
    assert got == plain(rows)
    assert H.mine(frame(spark, []), H.moved()).count() == 0
    assert H.mine(frame(spark, rows[6:7]), H.moved()).count() == 0


def test_sql_says_the_same(spark):
    rows = some(8, 250, 6)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(H.SQL).fetchall(), key=str) == plain(rows)


def test_products_are_exact():
    r = np.random.default_rng(1)
    a, b = r.integers(-(1 << 28), 1 << 28, (7, 33)), r.integers(-(1 << 28), 1 << 28, (9, 33))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert H.product(a, b).tolist() == want
    small = H.product(a >> 20, b >> 20)
    assert small.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b >> 20] for p in a >> 20]


def test_copies_of_the_anchors_are_not_broadcast(spark):
    """Their size is told too small once the anchors are known to be few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = H.mine(frame(spark, some(4, 400, 40)), H.moved())
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    joined = re.findall(r"BroadcastHashJoin \[([a-z_]+)#", plan.split("== Initial Plan ==")[0])
    assert set(joined) <= {"uid"}


def test_ranks_of_a_tile():
    r = np.random.default_rng(2)
    for top in (5, 1 << 40, 1 << 61):
        scores = r.integers(-top, top, (6, 50))
        order, falling = H.ranked(scores)
        assert order.tolist() == [sorted(range(50), key=lambda j: (-row[j], j)) for row in scores.tolist()]  # noqa: B023
        assert falling.tolist() == [sorted(-x for x in row) for row in scores.tolist()]


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_tiles_of_the_same_anchors_give_their_best_together(monkeypatch, held):
    monkeypatch.setattr(H, "HELD", held)
    panel = lambda *rows: [np.array(rows, np.int64).tobytes()]
    whole = [0, H.LEAST + 1, H.MOST]
    pair = lambda a, ids, rows: {"a": a, "a_uids": [10 * a, 10 * a + 1], "windows": [whole, [0, 2, 3, 1, -9, -9]], "a_panels": panel([1], [-1]), "b_uids": [100 + i if i else 99 for i in ids], "b_ids": ids, "b_panels": panel(*[[x] for x in rows])}
    kinds = pa.schema([("a", pa.int64()), ("a_uids", pa.list_(pa.int64())), ("windows", pa.list_(pa.list_(pa.int64()))), ("a_panels", pa.list_(pa.binary())), ("b_uids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())), ("b_panels", pa.list_(pa.binary()))])
    pairs = [pair(1, [1, 2], [5, 9]), pair(1, [3, None], [9, 9]), pair(2, [4], [-3])]
    got = [x for b in H.best_of(2)(pa.RecordBatch.from_pylist([p], kinds) for p in pairs) for x in [list(zip(*b.to_pydict().values(), strict=True))]]
    assert got == [
        [(10, 0, 102, 2, 9), (10, 0, 103, 3, 9), (11, 1, 102, 2, -9), (11, 1, 103, 3, -9)],
        [(20, 0, 104, 4, -3), (21, 0, 104, 4, 3)],
    ]


def test_grid():
    assert H.grid(1, 8) == (1, 1) and H.grid(5, 8) == (1, 5) and H.grid(300, 12) == (1, 38) and H.grid(300, 600) == (5, 120)
