import random

import pytest

from lodestone.llm import common
from lodestone.llm import components, near_dedup

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, limit=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= limit * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n long").repartition(3)
    assert set(map(tuple, near_dedup.near_duplicates(docs).collect())) == brute(rows)


def test_hot_family_and_edges(spark):
    r = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "a b c d"), (6, "A b  c\nd"), (7, "a b c d e")]
    for i in range(10, 260):  # copies of one text with few to many edits: a hot bucket that is not one component
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            t[r.randrange(len(t))] = r.choice(words) + r.choice("xyz")
        rows.append((i, " ".join(t)))
    for i in range(300, 340):  # a passage that many share
        rows.append((i, " ".join([*base[:60], *(r.choice(words) for _ in range(60))])))
    rows += [(400 + i, "nothing like the others %d at all %d" % (i, i)) for i in range(20)] + [(500, "very " * 20_000)]
    check(spark, rows)


def test_chains_reach_the_least_id(spark):
    words = ["v%d" % i for i in range(300)]
    rows = [(90 - k, " ".join(words[10 * k : 10 * k + 100])) for k in range(12)]
    check(spark, rows)


def test_repeated_ids_null_ids_and_empty_table(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (9, "other words that nobody else has here")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (7, 4, 5, False), (None, 4, 5, False), (9, 3, 9, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.near_dedup_rows(docs).columns == ["doc_id", "text"]


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, i) for i in range(40, 60)]])
def test_components(spark, edges):
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {(x, find(x)) for x in parent}


def test_a_cut_leaves_no_shuffle_files_and_the_session_as_it_was(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return {f for f in found.split(",") if "shuffle_" in f and f.endswith(".data")}

    there, before = files(), spark.conf.get(common.CLEANUP, None)
    rows = common.cut(spark.range(0, 3000, 1, 3).selectExpr("id % 7 AS k").groupBy("k").count())
    assert not files() - there and rows.count() == 7 and spark.conf.get(common.CLEANUP, None) == before
