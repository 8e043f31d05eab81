import collections
import math
import zlib

import numpy as np
import pytest

from lodestone.llm import ppm

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TEXTS = ["The cat sat on the mat.", "the CAT", "", None, "a", "ab ab ab ab", "été  x", "zzzz " * 50, "the cat sat on the hat, then"] * 4


def stream(text):
    return [0] * ppm.ORDER + [b + 1 for b in (text or "").encode().translate(LOWER)] + [ppm.END]


def plain(train, keep):
    """The pruned counts by context, and a function that gives P(symbol | context) step by step."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    every = 0
    for t in train:
        s = stream(t)
        for i in range(ppm.ORDER, len(s)):
            every += 1
            for d in range(ppm.ORDER + 1):
                counts[d][tuple(s[i - d : i])][s[i]] += 1

    def p(context, symbol):
        out, excluded = 1.0, set()
        for d in range(ppm.ORDER, -1, -1):
            c = counts[d].get(tuple(context[len(context) - d :]), {})
            kept = {s: n for s, n in c.items() if n * keep > every}
            if not kept:
                continue
            whole = sum(c.values()) - sum(kept[s] for s in excluded)
            left = len(kept) - len(excluded)
            if whole + left <= 0:
                continue
            if symbol in kept:
                return out * kept[symbol] / (whole + left)
            rest = sum(n for s, n in c.items() if s not in kept)
            out *= (left + rest) / (whole + left)
            excluded = set(kept)
        return out / max(ppm.SYMBOLS - len(excluded), 1)

    return p


@pytest.mark.parametrize("keep", [1 << 18, 300, 20])
def test_scores_equal_a_plain_model(spark, monkeypatch, keep):
    monkeypatch.setattr(ppm, "KEEP", keep)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in ppm.scores(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))}
    p = plain([t for i, t in enumerate(TEXTS) if not held[i]], keep)
    words = {i: (t or "").encode().translate(LOWER).split() + [b" "] for i, t in enumerate(TEXTS)}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert any(held.values()) and len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        s, r = stream(t), got[i]
        assert r.score == pytest.approx(sum(math.log10(p(s[:k], s[k])) for k in range(ppm.ORDER, len(s))))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[i]))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n)
    context = stream("the cat")[:-1]
    assert sum(p(context, s) for s in range(1, ppm.SYMBOLS + 1)) == pytest.approx(1)


def test_rare_words_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    whole = sorted(map(tuple, ppm.scores(docs).select("doc_id", "n_known", "base_score").collect()))
    monkeypatch.setattr(ppm, "HEAVY", 2)
    few = sorted(map(tuple, ppm.scores(docs).select("doc_id", "n_known", "base_score").collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in few]
    assert np.allclose([x[2] for x in whole], [x[2] for x in few])


def test_empty_table_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.scores(empty).count() == 0
    only_held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ppm.scores(spark.createDataFrame([(only_held_out, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(-4 * math.log10(ppm.SYMBOLS))


def test_rare_ngrams_of_a_large_input_are_kept(spark, monkeypatch):
    """More than 2^18 training symbols, so that what occurs once is below one in 2^18 of them; several blocks and parts."""
    monkeypatch.setattr(ppm, "PART", 40_000)
    texts = ["ab" * 140_000, "Qx7%zé kk", "Qx7%zé kk Qx7", "b\x01a", ""] + ["the cat %d" % i for i in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert not held[0] and not held[1] and any(held)
    p = plain([t for t, h in zip(texts, held, strict=True) if not h], float("inf"))
    got = {r.doc_id: r.score for r in ppm.scores(docs).collect()}
    for i, t in enumerate(texts[1:], 1):
        s = stream(t)
        assert got[i] == pytest.approx(sum(math.log10(p(s[:k], s[k])) for k in range(ppm.ORDER, len(s))))


def test_rows_without_an_id_long_texts_and_clashing_names(spark):
    """A null id trains, a text of more than CHUNK bytes is scored whole, and columns that have the names of the operator's own change nothing."""
    long = "ab " * (ppm.CHUNK // 3 + 10)
    assert len(long) > ppm.CHUNK
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    trains = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    rows = [(None, "cd ab"), (None, "cd ab"), (trains, long), (held, "ab cd ef")]
    extra = "row kind block part blob n rare held_out score".split()
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)).repartition(2)
    got = ppm.scores(docs).collect()
    assert got and len(got) == len(rows) and got[0].__fields__ == "doc_id held_out n_tokens n_known train_tokens base_score score".split()
    n = long.count(" ") + 1 + 2 * 3
    assert all(r.train_tokens == n for r in got)
    by = {r.doc_id: r for r in got}
    assert by[held].held_out and not by[None].held_out and not by[trains].held_out
    assert (by[trains].n_tokens, by[trains].n_known) == (long.count(" ") + 1,) * 2
    assert (by[held].n_tokens, by[held].n_known) == (4, 3)
    p = plain([t for i, t in rows if i != held], float("inf"))
    for i in (None, held):
        s = stream(dict(rows)[i])
        assert by[i].score == pytest.approx(sum(math.log10(p(s[:k], s[k])) for k in range(ppm.ORDER, len(s))))
    assert by[None].score == next(r.score for r in reversed(got) if r.doc_id is None)
