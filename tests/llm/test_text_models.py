import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import fingerprint, htmltext, langid, urlfilter

# ---- language ID


def all_cuts(word):
    for bits in itertools.product([0, 1], repeat=len(word) - 1):
        cuts = [0, *(i + 1 for i, b in enumerate(bits) if b), len(word)]
        yield [word[a:b] for a, b in zip(cuts, cuts[1:])]


def test_forward_sums_all_segmentations():
    path = langid.vocabulary_path()
    ids, lattice = langid.pieces(path), langid.Lattice(path)
    r = np.random.default_rng(1)
    p = np.concatenate([r.random((len(ids) + 1, 3)) / 100, np.zeros((1, 3))])
    words = ["▁the", "▁tion", "▁été", "▁ж水a"]
    for w in words:
        want = np.zeros(3)
        for cut in all_cuts(w):
            i = [ids.get(x, lattice.unknown if len(x) == 1 else None) for x in cut]
            if None not in i:
                want += np.prod(p[i], 0)
        c = lattice.characters([w])
        assert np.allclose(np.exp(lattice.forward(c, p)[0]), want)
        # expected counts of pieces, times their lengths, make up the word
        size = {i: len(x) for x, i in ids.items()} | {lattice.unknown: 1}
        found = list(lattice.expected(c, p[:, 0]))
        assert sum(size[int(i)] * x for _, piece, n in found for i, x in zip(piece, n)) == pytest.approx(len(w))


def plain_forward(word, p):
    """log10-free sums over all segmentations as exact fractions of p: dict piece -> probability, single characters at least p[None]."""
    from fractions import Fraction

    f = [Fraction(1)]
    for end in range(1, len(word) + 1):
        f.append(sum(f[a] * p.get(word[a:end], p[None] if end - a == 1 else 0) for a in range(max(0, end - 16), end)))
    return f


def log_of(x):
    """Of a fraction of any size."""
    n, d = x.numerator, x.denominator
    shift = n.bit_length() - d.bit_length()
    return math.log(n / (d << shift) if shift >= 0 else (n << -shift) / d) + shift * math.log(2)


def test_whole_long_words(monkeypatch):
    """Words far longer than a double's range, in several steps, against exact fractions."""
    from fractions import Fraction

    monkeypatch.setattr(langid, "STEP", 64)
    path = langid.vocabulary_path()
    ids, lattice = langid.pieces(path), langid.Lattice(path)
    r = random.Random(2)
    p = np.array([r.choice([1e-14, 1e-5, 0.25]) for _ in range(len(ids) + 1)] + [0.0])
    exact = {x: Fraction(float(p[i])) for x, i in ids.items()} | {None: Fraction(float(p[lattice.unknown]))}
    for n in (15, 16, 17, 63, 64, 65, 129, 300):
        word = "▁" + "".join(r.choice(["the", "tion", "qz", "ж", "straße", "\u0301"]) for _ in range(n))[: n - 1]
        f = plain_forward(word, exact)
        assert lattice.forward(lattice.characters([word]), np.stack([p, p], 1))[0] == pytest.approx([log_of(f[-1])] * 2)
        got, size = {}, {i: len(x) for x, i in ids.items()} | {lattice.unknown: 1}
        for _, piece, count in lattice.expected(lattice.characters([word]), p):
            for i, x in zip(piece, count):
                got[int(i)] = got.get(int(i), 0) + x
        back = plain_forward(word[::-1], {k if k is None else k[::-1]: v for k, v in exact.items()})[::-1]
        want = {}
        for a in range(n):
            for e in range(a + 1, min(n, a + 16) + 1):
                i = ids.get(word[a:e], lattice.unknown if e == a + 1 else None)
                if i is not None:
                    want[i] = want.get(i, 0) + float(f[a] * Fraction(float(p[i])) * back[e] / f[-1])
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
        assert sum(size[i] * x for i, x in got.items()) == pytest.approx(n)


def test_predictions_equal_a_plain_model(spark):
    """lang_pred and score of every row, from counts of all segmentations worked out word by word in exact fractions."""
    from fractions import Fraction

    r = random.Random(6)
    vocabulary = {"en": "the house of water and stone was old".split(), "de": "das haus und der stein im wasser straße".split(), "fr": "la maison et l'eau des pierres été".split()}
    rows = [(i, " ".join(r.choice(vocabulary[l]) for _ in range(r.randint(1, 6))), l, "x", 0.5, True) for i, l in enumerate(["en", "de", "fr"] * 8)]
    rows += [(90, "Haus HOUSE maison", None, "x", 0.5, True), (91, None, "en", None, None, None), (92, "7 !", "de", "", 0.0, False), (93, "w" * 90 + " das", "de", "x", 0.5, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    ids = langid.pieces(langid.vocabulary_path())
    start = {x: Fraction(1, len(ids) + 1) for x in [*ids, None]}
    counts = {}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    for i, text, lang, *_ in rows:
        for w in langid.words_of(text or "") if lang and not held[i] else []:
            w = "▁" + w
            f, back = plain_forward(w, start), plain_forward(w[::-1], {k if k is None else k[::-1]: v for k, v in start.items()})[::-1]
            for a in range(len(w)):
                for e in range(a + 1, min(len(w), a + 16) + 1):
                    piece = w[a:e] if w[a:e] in ids else None
                    if piece or e == a + 1:
                        own = counts.setdefault(lang, {})
                        own[piece] = own.get(piece, 0) + float(f[a] * start[piece] * back[e] / f[-1])
    langs = sorted(counts)
    total = {lang: sum(c.values()) + langid.SMOOTH * (len(ids) + 1) for lang, c in counts.items()}
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    assert any(held.values()) and len(got) == len(rows)
    for i, text, *_ in rows:
        words = langid.words_of(text or "")
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        scores = []
        for lang in langs:
            p = {x: Fraction((counts[lang].get(x, 0) + langid.SMOOTH) / total[lang]) for x in [*ids, None]}
            scores.append(sum(log_of(plain_forward("▁" + w, p)[-1]) for w in words))
        best = max(range(len(langs)), key=lambda k: scores[k])
        assert (got[i].lang_pred, got[i].held_out) == (langs[best], held[i])
        assert got[i].score == pytest.approx(1 / sum(math.exp(s - scores[best]) for s in scores))


def test_language_edges_and_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 ²Ⅷ __ !", "en"), (4, "the " * 30_000 + "x" * 5000, None), (None, "the and of", "en"), (None, "the and of", "en"), (6, "der und die", "de"), (6, "der und die", "de")], "doc_id long, text string, lang string")
    rows = langid.identify(odd.repartition(2)).collect()
    by = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in rows}
    assert len(rows) == 8 and [by[i][:2] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and by[4][0] == "en" and by[None][2] is False
    none = odd.where("lang is null")
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"] and langid.identify(odd.limit(0)).count() == 0
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def test_formulas_code_and_fallbacks_are_text():
    page = "<body><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><xmp>code</xmp><object data=a>inner</object><noembed>old</noembed></body>"
    assert [b.text for b in htmltext.blocks(page)] == ["Let x=2 be", "code", "inner", "old"]


# ---- fingerprints


def plain_level(x):
    """One level of one text by loops."""
    from lodestone.llm.shingles import mixed

    big = 1 << 64
    y = [x[0]] if len(x) == 1 else []
    if not y:
        for s, run in itertools.groupby(x):
            n = len(list(run))
            y.append(s if n == 1 else int(mixed(np.array([s], np.uint64) + mixed(np.array([n], np.uint64)))[0]))
    label = y
    for _ in range(4):
        bits = [0 if k == 0 else ((v ^ label[k - 1]) & -(v ^ label[k - 1])).bit_length() - 1 for k, v in enumerate(label)]
        label = [2 * b + (v >> b & 1) for b, v in zip(bits, label)]
    starts = [k for k in range(len(y)) if k == 0 or (label[k] > label[k - 1] and (k == len(y) - 1 or label[k] > label[k + 1]))]
    names = []
    for a, b in zip(starts, [*starts[1:], len(y)]):
        total = 0
        for q, v in enumerate(y[a:b]):
            w = (v * 0xBF58476D1CE4E5B9 + q * 0x9E3779B97F4A7C15) % big
            w = (w ^ w >> 29) * 0x94D049BB133111EB % big
            total = (total + (w ^ w >> 32)) % big
        names.append(int(mixed(np.array([total], np.uint64))[0]))
    return names


def phrases(text):
    """The names of a text's levels 2 and 3."""
    x, out = [ord(c) + 1 for c in text], set()
    for level in (1, 2, 3):
        x = plain_level(x) if x else []
        out |= {(level, v) for v in x if level > 1}
    return out


def shared(a, b):
    a, b = phrases(a), phrases(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def alone(text):
    return fingerprint.Prints([text]).text(0)


def test_fingerprints_follow_the_stated_order(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abcde \n") for _ in range(r.choice([0, 1, 2, 3, 50, 3000])))) for i in range(0, 240, 2)]
    rows += [(11, None), (13, "same " * 300), (15, "same " * 300), (17, "é😀" * 60_000)]
    docs = spark.createDataFrame([(*x, "f") for x in rows], "doc_id long, text string, fingerprint string").repartition(7)
    got = {x.doc_id: x for x in fingerprint.fingerprint(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (alone(t), alone(e))
        if len(t) < 5000:
            assert (x.near_edited, x.near_next) == pytest.approx((shared(t, e), shared(t, u)))
    assert got[13].fingerprint == got[15].fingerprint != got[17].fingerprint


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string"
    assert fingerprint.fingerprint(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.fingerprint(spark.createDataFrame([(3, "abcdef")], schema)).collect()
    assert [(x.doc_id, x.edited_sha256, x.near_next) for x in one] == [(3, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    odd = fingerprint.fingerprint(spark.createDataFrame([(None, "x"), (None, "x"), (1, "yy"), (1, "yy"), (2, None)], schema)).collect()
    assert sorted(str(x.doc_id) for x in odd) == ["1", "1", "2", "None", "None"]


def test_phrases_do_not_depend_on_offset():
    r = random.Random(9)
    text = "".join(r.choice("abcdefghij klmn") for _ in range(4000))
    prints = fingerprint.Prints([text, "some words before " + text, "".join(r.choice("abcdefghij klmn") for _ in range(4000)), text])
    a = np.zeros(3, int)
    moved, other, same = prints.likeness(a, a + [1, 2, 3])
    assert moved > 0.85 and other < 0.1 and same == 1 and prints.text(0) == prints.text(3)
    assert (prints.sketch[0] == prints.sketch[1]).mean() > 0.85 and prints.top[0] != prints.top[1]


def test_ids_of_many_rows_are_split(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(r.choice([None, None, 7, 7, 7, 9, 5, r.randint(10, 99)]), "".join(r.choice("ab c") for _ in range(30)) + str(i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    by_hash = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda x: (x.doc_id is None, -(x.doc_id or 0), x.h))
    texts = [x.text for x in by_hash]
    want = [(x.doc_id, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()) for x, t, u in zip(by_hash, texts, texts[1:] + texts[:1])]
    assert sorted(map(str, want)) == sorted(str((x.doc_id, x.edited_sha256)) for x in fingerprint.fingerprint(docs).collect())
    parts = fingerprint.in_order(docs, "doc_id", "text").where("not tail").groupBy("id", "part").count().collect()
    assert max(x["count"] for x in parts) < 150


def test_parse_equals_a_plain_version():
    r = random.Random(1)
    for _ in range(400):
        texts = ["".join(r.choice("abc d") for _ in range(r.randint(1, r.choice([1, 2, 3, 5, 40])))) for _ in range(r.randint(1, 6))]
        x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        first = np.zeros(len(x), bool)
        first[np.cumsum([0, *map(len, texts[:-1])])] = True
        want = [[ord(c) + 1 for c in t] for t in texts]
        for _ in range(3):
            x, first = fingerprint.parse(x, first)
            want = [plain_level(w) for w in want]
            assert x.tolist() == sum(want, [])


# ---- URL filter


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0] or [len(rest)])
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([k for k in (path.find(c) for c in "?#") if k >= 0] or [len(path)])]


def listed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_equal_a_plain_version(spark):
    r = random.Random(3)
    urls = [None, "", "no scheme", "http://", "HTTP://NET/", "x://a.net", "x://net/en/", "http://EXAMPLE.net/en/1?x://y", "http://example.net/e", "http://badexample.com/de/", "http://a.example.com/de/x", "http://a.org/fr/", "http://org/fr", "s://h?q/://z", "://ü.net/", "http://a.net/\n/b?c", "a://b.com/" + "p/" * 20_000]
    urls += [f"https://{r.choice(['a', 'b', 'www'])}.example.{r.choice(['net', 'com', 'org'])}/{r.choice(['en', 'de', 'fr'])}/{r.randint(1, 99)}{r.choice(['', '.html', '/', '?q=1', '#x'])}" for _ in range(600)]
    rows = [(i, u, "t", "v") for i, u in enumerate(urls)] + [(0, None, "t", "v"), (None, urls[-1], "t", "v")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, tokens string, verdict string").repartition(3)).collect()
    assert len(got) == len(rows)
    # brute force of the mined part: all token sets of the URLs that the list judges
    tokens = {}

    def items(host, path):
        if (host, path) not in tokens:
            labels, parts = host.split("."), [p for p in path.split("/") if p]
            zero = lambda s: "".join("0" if d else "".join(g) for d, g in itertools.groupby(s, lambda c: c in "0123456789"))
            kind = __import__("re").search(r"\.([A-Za-z0-9]+)$", path)
            t = {f"label={x}" for x in labels} | {"host=" + ".".join(labels[k:]) for k in range(len(labels))} if host else set()
            t |= {f"part{k}={zero(x)}" for k, x in enumerate(parts)} | ({f"kind={kind[1]}"} if kind else set())
            tokens[host, path] = frozenset(t)
        return tokens[host, path]

    split = [(u, *split_url(u)) for _, u, _, _ in rows]
    judged = [(items(h, p), listed(h, p)[1]) for _, h, p in split if listed(h, p)[0]]
    have, with_verdict = {}, {}
    for t, v in judged:
        for n in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), n):
                have[s] = have.get(s, 0) + 1
                with_verdict[s, v] = with_verdict.get((s, v), 0) + 1
    rules = {(s, v): (n / have[s], n / len(judged)) for (s, v), n in with_verdict.items() if n >= math.ceil(urlfilter.SUPPORT * len(judged)) and n / have[s] >= urlfilter.CONFIDENCE}
    by = {(x.page_id, x.host, x.path): x for x in got}
    for (i, u, _, _), (_, h, p) in zip(rows, split):
        rule, verdict = listed(h, p)
        if verdict is None:
            t = items(h, p)
            fits = [(c, s, v == "allow", v) for (k, v), (c, s) in rules.items() if set(k) <= t]
            verdict = max(fits)[3] if fits else "allow"
        x = by[i, h, p]
        assert (x.rule, x.verdict) == (rule, verdict), (u, t)
    # a URL of many parts that many rows share: its tokens are one class, whatever their number
    deep = [(i, f"http://a.net/{'/'.join('d%s' % chr(97 + k) for k in range(26))}/{'p/' * 2000}z/{i}") for i in range(50)] + [(100 + i, f"http://b.org/fr/{i}") for i in range(50)]
    wanted = spark.createDataFrame([(i, "block" if i < 50 else "allow") for i, _ in deep if i % 2], "page_id long, verdict string")
    found = urlfilter.judge(spark.createDataFrame([*deep, (500, "http://c.com/q/dz/dy")], "page_id long, url string"), rules=(), labels=wanted).collect()
    assert {x.page_id: x.verdict for x in found} == {i: "block" if i < 50 else "allow" for i, _ in deep} | {500: "allow"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(empty).count() == 0
    assert [x.verdict for x in urlfilter.judge(spark.createDataFrame([(1, "http://a.example/x")], "page_id long, url string")).collect()] == ["allow"]


# ---- HTML


def test_blocks():
    page = """<!DOCTYPE html><head><title>T &amp; t</title><script>var t="</p>"; x</script></head><body><NAV class=x>m<li>n</nav><!-- no <p>x</p> -->
    <p>one<b>two</b> <br>three&nbsp;&lt;p&gt;<p>four<div id='a "b' data-x="<p>">it's <a title=it's>5</a></div><p don't>six <1 7>2 &#x41;"""
    assert [b.text for b in htmltext.blocks(page)] == ["T & t", "m", "n", "onetwo three <p>", "four", "it's 5", "six <1 7>2 A"]
    assert htmltext.blocks(page)[1].path[-2:] == ("nav", ".x") and htmltext.blocks(page)[4].path[-1] == "p"
    assert htmltext.blocks("") == [] and htmltext.blocks("<p></p> <script>x") == [] and [b.text for b in htmltext.blocks("<" * 2000 + "a")]
    assert len(htmltext.blocks("<p>x" * 30_000)) == 30_000
    assert htmltext.blocks("<p a='" * 500 + "x") == []  # one tag that never ends


def test_gradients_are_right():
    r = np.random.default_rng(0)
    m = htmltext.Labeller(2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = r.normal(size=(2, 4, htmltext.PATH + htmltext.WORDS + htmltext.MEASURES))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0]], float)

    def loss():
        q = m.predict(x, mask)
        return -(mask * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / mask.sum()

    grads = {}
    probe = htmltext.Labeller(2)
    probe.p = {k: v.copy() for k, v in m.p.items()}
    probe.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    probe.learn(x, mask, y)
    grads = {k: probe.m[k][0] / 0.1 for k in m.p}
    for k, a in m.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in a.shape)
            old, step = a[at], 1e-3
            a[at] = old + step
            up = loss()
            a[at] = old - step
            down = loss()
            a[at] = old
            assert grads[k][at] == pytest.approx((up - down) / (2 * step), rel=3e-2, abs=1e-5), k


def test_extraction_of_held_out_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(pages, sample=120).collect()}
    right = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner[1] if inner else ""))).split())
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert right >= 0.98 * len(got)
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (2, None, "", "t"), (None, "u", "plain", "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.n_chars == len(r.text)) for r in htmltext.extract(odd).collect()) == [("1", True), ("2", True), ("2", True), ("None", True)]
    assert htmltext.extract(odd.limit(0)).count() == 0


def test_all_letter_pieces_of_the_vocabulary_are_used():
    import sentencepiece

    path = langid.vocabulary_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    long = {p.lower() for p in every if len(p) > 8 and p.strip("▁").isalpha()}
    assert long and long <= set(langid.pieces(path))
    lattice, word = langid.Lattice(path), max(long, key=len)
    assert lattice.edges(lattice.characters([word]), 0, len(word))[0, -1, len(word) - 1] == langid.pieces(path)[word]


def test_combining_marks_belong_to_their_words():
    assert langid.words_of("हिन्दी भाषा, e\u0301te\u0301 \u0301 7") == ["हिन्दी", "भाषा", "e\u0301te\u0301"]


def test_raw_elements_end_where_they_end():
    page = "<body><p>" + "İ" * 9 + "</p><SCRIPT>x < y</Script ><p>a<b>b</b></p><style>p{}</style><div>end</div></body>"
    assert [b.text for b in htmltext.blocks(page)] == ["İ" * 9, "ab", "end"]


def plain_lstm(m, x):
    """Chances of one page's blocks, a number at a time."""
    n, sig = len(x), lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for way in "fb":
        w, u, c0 = (m.p[k + way].astype(float) for k in "WUc")
        h, c = [0.0] * htmltext.HIDDEN, [0.0] * htmltext.HIDDEN
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            a = c0 + x[t].astype(float) @ w + np.array(h) @ u
            i, f, o, g = (a[k * htmltext.HIDDEN : (k + 1) * htmltext.HIDDEN] for k in range(4))
            c = [sig(f[j]) * c[j] + sig(i[j]) * math.tanh(g[j]) for j in range(htmltext.HIDDEN)]
            h = [sig(o[j]) * math.tanh(c[j]) for j in range(htmltext.HIDDEN)]
            states[way, t] = h
    return [sig(float(np.concatenate([states["f", t], states["b", t], x[t]]) @ m.p["V"][:, 0] + m.p["v"][0])) for t in range(n)]


def test_labels_equal_a_plain_lstm(monkeypatch):
    """Pages of different lengths in one batch, and a page longer than what is labelled at once."""
    r, m, vectors = random.Random(3), htmltext.Labeller(4), htmltext.Vectors()
    pages = [[htmltext.Block((r.choice(["div", "p", "nav"]), ".c%d" % r.randint(0, 9)), "w%d and. more" % r.randint(0, 99), r.random()) for _ in range(n)] for n in (1, 7, 0, 12, 40)]
    want = [plain_lstm(m, vectors.of(p)) for p in pages]
    for at_once in (10_000, 13, 5):
        monkeypatch.setattr(htmltext, "AT_ONCE", at_once)
        got = htmltext.label(m, pages, vectors)
        assert all(g == pytest.approx(w, abs=1e-5) for g, w in zip(got, want))


def test_huge_and_odd_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").limit(40)
    odd = [(10_000, "u", "<body><article>" + "<p>Some words of the story, as it was told.</p>" * 30_000 + "</article></body>"), (10_001, "u", "<body><article><p>" + "\u0130" * 9 + "</p><script>x</script><p>Hello world, and more of it.</p></article></body>")]
    docs = pages.unionByName(spark.createDataFrame(odd * 2, "page_id long, url string, html string")).select("*", "page_id", "url").toDF("page_id", "url", "html", "n_chars", "text")
    got = [r for r in htmltext.extract(docs, sample=60).collect() if r.page_id >= 10_000]
    assert len(got) == 4 and all(len(r.text) == r.n_chars for r in got)
    assert {r.n_chars for r in got if r.page_id == 10_000} == {41 * 30_000 - 1}
    assert {r.text for r in got if r.page_id == 10_001} == {"\u0130" * 9 + " Hello world, and more of it."}


def test_pages_without_names(spark):
    """Layouts whose class words say nothing: most of the menus and footers still go, and most of the text stays."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = htmltext.learnt(pages, "page_id", "html", 200)
    model, vectors = htmltext.worker_state(weights)
    r, right, every = random.Random(1), 0, 0
    for page in pages.limit(80).collect():
        own = htmltext.blocks(page.html)
        truth = [htmltext.weak_label(b.path) for b in own]
        found = htmltext.label(model, [htmltext.unnamed(own, r)], vectors)[0] > 0.5
        right, every = right + sum(a == b for a, b in zip(truth, found)), every + len(own)
    assert right >= 0.9 * every, (right, every)
