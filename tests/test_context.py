"""The context index over files of all formats, and readers' guards."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search_index
from lodestone.plans import context, planner
from lodestone.sources import readers

FILES = [
    ("view.html", "template", "<!-- private hint --><p>{{ needle }}</p><div [innerHTML]=\"value\"></div>"), ("config.yml", "configuration", "limits:\n  attempts: 3 # hint\n"), ("bad.yml", "configuration", "a: [1]\n"),
    ("a/package.json", "configuration", '{"needle": 1 /* hint */}'), ("broken.json", "configuration", '{"value":'), ("server.ts", "tsjs", "app.get()"), ("x.toml", "configuration", "needle = 1"), ("page.pug", "template", "p needle"),
    ("empty.json", "configuration", ""), ("lost.yml", "configuration", None),
]


def test_every_format_has_its_evidence(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, language string, text string").withColumn("hash", F.sha2("text", 256))
    tables = context.index(files)
    out = {k: v.collect() for k, v in tables.items()}
    assert {r.file: (r.capability, r.reasons) for r in out["context_files"]} == {
        "view.html": ("indexed", []), "config.yml": ("indexed", []), "bad.yml": ("partial", ["yaml_parse_error"]), "a/package.json": ("indexed", []), "broken.json": ("partial", ["json_parse_error"]),
        "server.ts": ("unavailable", ["needs_a_language_parser"]), "x.toml": ("partial", ["format_semantics_unavailable"]), "page.pug": ("partial", ["format_semantics_unavailable"]),
        "empty.json": ("partial", ["json_parse_error", "no_reviewable_declarations"]), "lost.yml": ("unavailable", ["unreadable"]),
    }
    assert {(r.file, r.kind) for r in out["subjects"]} == {("view.html", "template"), ("config.yml", "configuration"), ("bad.yml", "configuration"), ("a/package.json", "dependency_manifest"), ("broken.json", "configuration"), ("x.toml", "configuration"), ("page.pug", "template")}
    texts = {r.file: r.text for r in out["texts"]}
    lengths = {p: len(t) for p, _, t in FILES if t is not None}
    assert set(texts) == set(lengths) - {"server.ts"} and all(len(t) == lengths[f] and "hint" not in t for f, t in texts.items())
    kinds = {(r.file, r.kind) for r in out["anchors"]}
    assert kinds == {("view.html", "template_node"), ("view.html", "template_attribute"), ("config.yml", "configuration_node"), ("a/package.json", "configuration_property"), ("broken.json", "configuration_property")}
    search_index.write(str(tmp_path), 1, tables["texts"], "file", "text", 2)
    page = search_index.page(spark, str(tmp_path), 1, "needle")
    assert sorted(m[0] for m in page.matches) == ["a/package.json", "page.pug", "view.html", "x.toml"]


def test_functions_get_their_files_purpose(spark):
    functions = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, file string")
    contexts = spark.createDataFrame([("a", "vendor"), ("a", "vendor")], "file string, purpose string")
    assert sorted((r.id, r.purpose) for r in planner.with_purpose(functions, contexts).collect()) == [(1, "vendor"), (2, None), (3, None)]


def test_records_are_bounded_before_they_are_parsed(spark, tmp_path):
    schema = "a int, b string"
    write = lambda name, *lines: (tmp_path / name).write_text("\n".join(lines))
    write("good", '{"a": 1, "b": "[[[ \\" {"}', "  ", json.dumps({"a": 2, "b": "x"}))
    assert sorted(map(tuple, readers.bounded_lines(spark, str(tmp_path / "good"), schema, 100, 3).collect())) == [(1, '[[[ " {'), (2, "x")]
    for name, line, error in (("long", json.dumps({"a": 1, "b": "x" * 200}), "record_size_limit"), ("deep", '{"a": 1, "c": [[[1]]]}', "record_depth_limit"), ("broken", '{"a": ', "MALFORMED")):
        write(name, line)
        with pytest.raises(Exception, match=error):
            readers.bounded_lines(spark, str(tmp_path / name), schema, 100, 3).collect()


def test_public_files_and_changed_ones(spark):
    found = spark.createDataFrame([("public/a.png", 3, bytearray(b"abc")), ("src/a.ts", 5, bytearray(b"abc")), ("x/assets/.keep", 0, bytearray(b""))], "path string, bytes long, content binary")
    assert sorted(map(tuple, readers.public_assets(found).collect())) == [("public/a.png", 3, ".png"), ("x/assets/.keep", 0, "")]
    assert [r.path for r in readers.changed_while_read(found).collect()] == ["src/a.ts"]
