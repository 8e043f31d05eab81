import random

import duckdb
import pytest

from lodestone.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, row long, s string, h long, id long, _n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "k", 1, "s", 2, 3, 4, "key") if len(r) == 4 else r for r in [(i, t, None, s) for i, t, s in rows]], "doc_id long, text string, lang string, source string, n_chars string, keep string, row long, s string, h long, id long, _n long, key string")


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


ROWS = [
    [],
    [(1, None, None), (2, "", "a"), (3, "A b", "a"), (4, "a B", None), (5, "ä", "b"), (6, "Ä", "b"), (7, "a b", ""), (8, " a b", "")],
    [(i, "Same TEXT" if i % 3 else "same text %d" % (i % 5), "hot" if i % 4 else "s%d" % i) for i in range(400)] + [(1000, "w " * 50_000, "hot")],
    [(i, " ".join(["w"] * random.Random(i).randint(0, 40)), "s%d" % (i % 7)) for i in range(300)],
]


@pytest.mark.parametrize("rows", ROWS)
def test_exact_dedup_equals_sql(spark, rows):
    columns, want = duck(rows, exact_dedup.SQL)
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(5)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", ROWS)
def test_mixing_equals_sql(spark, rows):
    columns, want = duck(rows, mixing.SQL)
    got = mixing.mix(frame(spark, rows).repartition(5)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_mixing_takes_rows_without_an_id(spark):
    rows = [(None, "a b", "a"), (None, "c", None), (None, "c", None), (1, "d e f", "a"), (2, "g " * 30, "b"), (None, None, "b")]
    columns, want = duck(rows, mixing.SQL)
    got = mixing.mix(frame(spark, rows).repartition(3)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_targets_share_the_excess(spark):
    sums = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sums, (5, 2, 1), 1.5, 2.0).collect()}
    sizes, weights, targets = {"a": 10, "b": 1000, "c": 1000, "d": 0, None: 50}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {}
    left, total = set(sizes), 1.5 * sum(sizes.values())
    while True:  # as stated: excess is shared anew until none is above
        share = {s: total * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            total -= targets[s]
        left -= over
    assert got == pytest.approx(targets | share)


def test_rows_that_stay(spark):
    rows = [(1, "a", "x"), (2, "A", "x"), (2, "a", "x"), (3, "b", "y"), (None, "b", "y"), (None, "c", "y"), (None, "c", "y"), (4, None, None), (5, "", None)]
    docs = frame(spark, rows)
    got = exact_dedup.dedup_rows(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=str) == sorted([(2, "a"), (3, "b"), (None, "c"), (5, "")], key=str)
    assert exact_dedup.dedup_rows(docs.limit(0)).count() == 0


def test_smallest_may_stay_instead(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(i, "t", "x") for i in range(100)]), keep="min").where("kept").collect()
    assert [(r.doc_id, r.group_size) for r in got] == [(0, 100)]


def test_mixed_rows_are_what_is_taken(spark):
    docs = frame(spark, ROWS[3])
    taken = mixing.mix(docs).collect()
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert all(r.taken == r.size * counts.get(r.doc_id, 0) for r in taken)
    by = {}
    for r in taken:
        x = by.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
        x[1] = max(x[1], r.size)
    assert all(abs(words - target) <= most for (_, target), (words, most) in by.items())


def test_no_python_runs(spark):
    for f in (exact_dedup.exact_dedup, mixing.mix, exact_dedup.dedup_rows, mixing.mix_rows):
        plan = f(frame(spark, ROWS[1]))._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sources_of_rows_without_ids_meet_their_targets(spark):
    """Rows without an id, or of one id, are told apart by their texts."""
    r = random.Random(6)
    rows = [(None, " ".join(r.choice("abcdefgh") for _ in range(5)) + f" {i}", "b") for i in range(40)] + [(i, "x y", "b") for i in range(3)]
    rows += [(7, f"w{i} " * 4, "a") for i in range(60)] + [(100 + i, f"v{i} " * 9, "c") for i in range(90)]
    columns, want = duck(rows, mixing.SQL)
    got = mixing.mix(frame(spark, rows).repartition(3)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    taken = {}
    for x in got:
        taken.setdefault((x.source_size, x.target), []).append(x)
    assert len(taken) == 3
    for (_, target), some in taken.items():
        assert abs(sum(x.taken for x in some) - target) <= max(x.size for x in some)


def test_empty_rows_are_taken_no_more_often_than_others(spark):
    rows = [(i, "" if i % 2 else "a b c", "s") for i in range(60)] + [(100 + i, "w " * 40, "t") for i in range(9)]
    times = {}
    for x in mixing.mix_rows(frame(spark, rows)).collect():
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    assert max(times.values()) <= 2


def test_rows_of_one_id_are_dealt_over_all_runs(spark):
    rows = exact_dedup.leaf_rows(frame(spark, [(None, f"t{i % 9}", "x") for i in range(2000)]).repartition(3), "doc_id", "text", 64)
    sizes = [x["count"] for x in rows.groupBy("run").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 100
