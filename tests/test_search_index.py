"""The trigram index finds what reading every text finds."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import relations, search_index

TEXTS = {"a.ts": "needle in a text; needles", "b.ts": "nothing", "c/z.ts": "x" * 7997 + "needle" + "y" * 9000 + "needle", "d.ts": "", "e.ts": "ne", "f.ts": "need less le", "g.ts": "ü😀needle😀", "h.ts": None}


def scanned(texts, needle, prefix=""):
    out = []
    for file, text in sorted(texts.items()):
        for s in range(0, max(len(text or ""), 1), T.CHUNK) if text is not None and file.startswith(prefix) else ():
            body, at = text[s : s + T.CHUNK + T.OVERLAP], 0
            while (at := body.find(needle, at)) >= 0 and at < T.CHUNK:
                out.append((file, s + at, s + at + len(needle)))
                at += len(needle)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string").repartition(3)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    search_index.write(root, 1, frame(spark, TEXTS), "file", "text", 3)
    return root


@pytest.mark.parametrize("needle", ["needle", "eed", "les", "y" * 200, "absent", "😀need", "xxx"])
def test_all_matches_equal_a_scan(spark, needle):
    chunks = search_index.chunked(frame(spark, TEXTS), "file", "text")
    got = search_index.search_all(chunks, search_index.postings(chunks), needle)
    assert sorted(map(tuple, got.collect())) == sorted(scanned(TEXTS, needle))


@pytest.mark.parametrize(("needle", "prefix", "limit"), [("needle", "", 1), ("needle", "c/", 50), ("xxx", "", 50), ("needle", "zz", 3), ("absent", "", 3)])
def test_pages_have_every_match_once(spark, stored, needle, prefix, limit):
    found, cursor, pages = [], None, 0
    while True:
        page = search_index.page(spark, stored, 1, needle, prefix, cursor, limit)
        assert len(page.matches) <= limit and (page.completion == "partial") == bool(page.cursor)
        found, cursor, pages = found + page.matches, page.cursor, pages + 1
        if not cursor or pages > 60:
            break
    assert found == scanned(TEXTS, needle, prefix)[: len(found)]
    assert cursor or found == scanned(TEXTS, needle, prefix)


def test_a_page_reads_few_chunks(spark, tmp_path):
    texts = {f"{i:02}": "common text" for i in range(25)}
    search_index.write(str(tmp_path), 1, frame(spark, texts), "file", "text", 2)
    page = search_index.page(spark, str(tmp_path), 1, "common", limit=50)
    assert len(page.matches) == search_index.PAGE_CHUNKS and page.cursor and page.reasons[-1] == "page_budget"


def test_other_generations_cursors_and_gaps(spark, stored):
    cursor = search_index.page(spark, stored, 1, "needle", limit=1).cursor
    for needle, prefix in (("needles", ""), ("needle", "c/")):
        with pytest.raises(relations.StaleCursor):
            search_index.page(spark, stored, 1, needle, prefix, cursor)
    with pytest.raises(relations.StaleCursor):
        search_index.page(spark, stored, 2, "needle", "", cursor)
    for needle, limit in (("ab", 5), ("x" * 201, 5), ("a\0bc", 5), ("abc", 0), ("abc", 51)):
        with pytest.raises(ValueError):
            search_index.page(spark, stored, 1, needle, "", None, limit)
    files = spark.createDataFrame([("a.ts",), ("new.ts",)], "path string")
    contexts = spark.createDataFrame([("a.ts", "indexed")], "file string, capability string")
    page = search_index.page(spark, stored, 1, "absent", gaps=relations.gaps(files, contexts))
    assert (page.completion, page.unindexed, page.matches) == ("partial", 1, [])


def test_only_candidates_are_read(spark, stored):
    chunks = spark.read.parquet(f"{stored}/chunks/generation=1").where(F.col("chunk").isin([1, 2]))
    plan = chunks._jdf.queryExecution().toString()
    assert "PushedFilters: [In(chunk" in plan
    posted = spark.read.parquet(f"{stored}/postings/generation=1")
    plan = search_index.candidates(posted, "needle")._jdf.queryExecution().toString()
    assert "In(tri" in plan and "text" not in plan


def test_trigrams(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("aé😀 \n") for _ in range(r.randint(0, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", search_index.trigrams(F.col("t")).alias("x")).collect()
    assert all(sorted(x.x) == sorted({texts[x.i][k : k + 3] for k in range(len(texts[x.i]) - 2)}) for x in rows)


def test_a_search_of_all_texts_keeps_the_needles_postings_only(spark, sf):
    import os

    from lodestone import queries, session

    session.cut(spark.range(1))
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    there = lambda: {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs}
    before = there()
    assert queries.QUERIES["indexed_search"](spark, sf).count() > 0
    kept = sum(os.path.getsize(f) for f in there() - before)
    assert kept < 4 * spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
