import hashlib
import random
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm import bpe, mixing  # noqa: E402
from lodestone.llm import queries as llm  # noqa: E402

from .test_dedup_mixing import duck  # noqa: E402
from .test_near_dedup import brute  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(8)
    words = ["the", "of", "and", "tion", "ing", "er", "house", "garden", "river", "stone"] + ["w" + c for c in "abcdefghij"]
    rows = []
    for i in range(120):
        t = " ".join(r.choice(words) for _ in range(r.randint(6, 60)))
        rows.append((i, t, "en", "hot" if i % 3 else "s%d" % (i % 5), len(t)))
    for i in range(120, 170):  # exact and near copies
        t = rows[i % 7][1]
        t = t.upper() if i % 2 else t + " more"
        rows.append((i, t, None if i % 5 else "en", None if i % 4 == 0 else "hot", len(t)))
    return rows + [(900, None, "en", "x", None), (901, "", None, None, 0), (902, "12 34 !!", "en", "hot", 8), (903, "the " * 5000, "en", "s1", 20000), (5, rows[5][1], "en", "s1", 3)]


def plain(rows):
    """The stages in plain Python."""
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    best = {}
    for r in kept:
        best[low(r[1])] = max(best.get(low(r[1]), -1), r[0])
    seen, exact = set(), []
    for r in kept:
        k = (r[0], low(r[1]))
        if best[k[1]] == r[0] and k not in seen:
            seen.add(k)
            exact.append(r)
    stay = {i for i, _, _, ok in brute([(r[0], r[1]) for r in exact]) if ok}
    near = [r for r in exact if r[0] in stay]
    columns, mixed = duck([(r[0], r[1], r[3]) for r in near], mixing.SQL)
    taken = {x[columns.index("doc_id")]: x[columns.index("taken")] // max(x[columns.index("size")], 1) for x in mixed}
    return Counter({(r[0], hashlib.sha256(r[1].encode()).hexdigest()): taken[r[0]] for r in near if taken[r[0]]})


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == plain(rows)
    c = bpe.codec(bpe.vocabulary_path())
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.n_tokens == len(np.frombuffer(r.ids, "<u4"))
        assert r.doc_id == 5 or c.decode(bytes(r.ids)) == text[r.doc_id]


def test_stages_keep_columns_and_stand_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(documents()[:5], COLUMNS)
    wide = docs.selectExpr("*", "'x' as kept", "1 as row", "2 as id", "3 as _n", "4 as h", "5 as copies", "6 as node", "7 as component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, wide, "").columns == wide.columns and stage(spark, wide, "").count() >= 0
        assert stage(spark, docs.limit(0), "").count() == 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in llm.QUERIES] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
