import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash

SCHEMA = "doc_id long, text string, fp long, key long, component string, node string, a string, least string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "c", "n", "a", "l") for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs (id, fingerprint): the least id reachable, by id."""
    parent = {i: i for i, _ in pairs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x) in enumerate(pairs):
        for j, y in pairs[:n]:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def rows():
    r = random.Random(7)
    words = ["w%d" % i for i in range(400)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "solo")]
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([5, 60, 300]))]
        for _ in range(r.choice([1, 3, 14])):
            new = list(text)
            for _ in range(r.randint(0, 6)):
                new[r.randrange(len(new))] = r.choice(words)
            out.append((len(out) + 100 * base, " ".join(new)))
    out.append((9_000, "long " * 150_000))
    return out


def test_equals_comparing_all(spark):
    docs = rows()
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, docs).repartition(5)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == plain_components(sorted(prints.items()))
    assert all(len(r.fingerprint) == 16 for r in got.values())


@pytest.mark.parametrize("loose", [6, 14, 40])
def test_crowds_of_fingerprints(spark, loose):
    """Fingerprints around a few centres, the farther the more bits are loose: chains, links that no leader has, and hot values."""
    r = random.Random(loose)
    centres = [r.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << b for b in r.sample(range(loose), r.randint(0, min(loose, 7)))) for c in centres for _ in range(90)}
    table = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(fps))]
    found = simhash.links(spark.createDataFrame([(x,) for _, x in table], "fp long"), spark.createDataFrame([], "a long, b long"))
    component = {r.node: r.component for r in found.collect()}
    mask = (1 << 64) - 1
    want = plain_components([(x, x & mask) for x in sorted(x for _, x in table)])
    assert {x: component.get(x, x) for _, x in table} == want


def test_thresholds_are_cheapest():
    r = np.random.default_rng(3)
    near = np.cumsum(r.integers(0, 1000, (4, 5, 1 << 16)), 1).astype(float)
    values = r.integers(0, 1 << 16, (50, 4))
    got = simhash.thresholds(values, near, 4)
    assert (got.sum(1) + 4 == 5).all() and (got >= -1).all()
    probes = np.cumsum([1, 16, 120, 560, 1820])
    price = lambda v, t: sum(0 if k < 0 else near[i, k, v[i]] + probes[k] for i, k in enumerate(t))
    every = [(a, b, c, 1 - a - b - c) for a in range(-1, 5) for b in range(-1, 5) for c in range(-1, 5) if -1 <= 1 - a - b - c <= 4]
    assert all(price(v, t) == min(price(v, e) for e in every) for v, t in zip(values, got, strict=True))


def test_counts_within_are_exact():
    r = np.random.default_rng(5)
    h = np.zeros(1 << 16, np.int64)
    np.add.at(h, r.integers(0, 1 << 16, 300), 1)
    near, at = simhash.within(h, 4), np.flatnonzero(h)
    for v in r.integers(0, 1 << 16, 40):
        d = np.array([int(v ^ x).bit_count() for x in at])
        assert [near[t, v] for t in range(5)] == [h[at][d <= t].sum() for t in range(5)]


def test_rows_without_id_repeated_rows_and_empty_table(spark):
    docs = [(None, "a b c d e"), (7, "a b c d e"), (7, "x y z u v w q r"), (8, "x y z u v w q r"), (None, "quite another text of words"), (8, "x y z u v w q r")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (8, 7), (None, None), (8, 7)], key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
