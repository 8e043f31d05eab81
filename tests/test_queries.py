"""Every query that has SQL is held against DuckDB on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import queries as engine
from lodestone.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(rows):
    return sorted((tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", list(engine.ORACLE_SQL))
def test_equals_sql(spark, duck, sf, name):
    df = engine.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    r = duck.execute(engine.ORACLE_SQL[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == columns
    want = plain(tuple(x[have.index(c)] for c in columns) for x in r.fetchall())
    assert plain(tuple(x[c] for c in columns) for x in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    names = entry.queries()
    assert set(engine.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert ("pipeline" in names) == (importlib.util.find_spec("lodestone.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None)


def test_nothing_else_needs_the_optional_package():
    import ast
    import pathlib

    root = pathlib.Path(engine.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                assert "llm" not in str(getattr(node, "module", None)) and not any("llm" in a.name for a in getattr(node, "names", []) if isinstance(node, (ast.Import, ast.ImportFrom)))


def test_anchors_are_where_the_tags_are(spark, sf):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = engine.QUERIES["html_anchors"](spark, sf).collect()
    assert rows and all(html[r.page_id][r.start : r.end].lower().startswith("<" + r.tag) and html[r.page_id][r.end - 1] == ">" for r in rows)
