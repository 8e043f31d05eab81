"""Functions and operators on small fixtures."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import markup, relations, scoring
from lodestone.plans import coverage, lifecycle, planner
from lodestone.sources import readers, sinks

TEXTS = ["", "a", "x <!-- c --> y", "<!---->z<!--\r\n é😀 -->", "<<!-- a", "a<b>c</b>\n<!-- - -- -->", " <!--    -->"]


def test_masking_keeps_length_and_line_ends(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", markup.masked(F.col("t")).alias("m"), T.mask(F.col("t")).alias("all")).collect():
        assert len(r.m) == len(r.t) == len(r.all)
        assert all(a == b or (b == " " and a not in "\r\n  ") for a, b in zip(r.t, r.m))
        assert "<!-- c" not in r.m and set(r.all) <= set(" \r\n  ")


def test_lines_occurrences_and_chunks(spark):
    rows = [("a\n\nbc", "\n"), ("", "x"), ("aaaa", "aa"), ("a.b.c", "."), ("q\\Eq\\E", "\\E"), ("x" * 20, "y"), ("needle in needle", "needle"), ("abc", "")]
    df = spark.createDataFrame(rows, "t string, n string")
    for r in df.select("t", "n", T.lines(F.col("t")).alias("l"), T.occurrences(F.col("t"), F.col("n")).alias("o"), T.chunks(F.col("t"), 8, 2).alias("c")).collect():
        at, want = 0, []
        for k, line in enumerate(r.t.split("\n")):
            want.append((k + 1, at, at + len(line)))
            at += len(line) + 1
        assert [tuple(x) for x in r.l] == want
        found, k = [], r.t.find(r.n) if r.n else -1
        while k >= 0:
            found.append(k)
            k = r.t.find(r.n, k + len(r.n))
        assert r.o == found
        assert [(c.start, c.text) for c in r.c] == [(s, r.t[s : s + 10]) for s in range(0, max(len(r.t), 1), 8)]


def test_every_match_is_owned_by_one_chunk(spark):
    r = random.Random(1)
    text = "".join(r.choice("ab ") for _ in range(500))
    chunks = spark.createDataFrame([(text,)], "t string").select(F.explode(T.chunks(F.col("t"), 50, 10)).alias("c"))
    got = sorted(x.start + at for x in chunks.select("c.start", T.owned(F.col("c.text"), F.lit("ab a"), 50).alias("o")).collect() for at in x.o)
    assert {i for i in range(len(text)) if text.startswith("ab a", i)} >= set(got) and len(got) == len(set(got)) > 0


def test_paths(spark):
    rows = {"src/Tests/a.js": ("test_or_fixture", "tsjs", True), "a/tools/x.cs": ("example_or_tooling", "csharp", False), "vendors/y.vue": ("vendor", "template", False), "db/seeds/z.mts": ("initialization", "tsjs", True), "lib/x.d.ts": ("application_candidate", "tsjs", False), "README.md": ("application_candidate", "documentation", False)}
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    for r in df.select("p", P.purpose(F.col("p")).alias("u"), P.language(F.col("p")).alias("l"), P.is_source(F.col("p")).alias("s")).collect():
        assert (r.u, r.l, r.s) == rows[r.p]
    df = spark.createDataFrame([("a/./b//../c", "a/c"), ("../x", "x"), ("", ""), ("a/b/../../c", "c")], "p string, want string")
    assert all(r.want == r.n for r in df.select("want", P.normalized(F.col("p")).alias("n")).collect())
    safe = {"a/b": True, "/a": False, "a/../b": False, "a//b": False, "": False, "a\\b": False, "./a": False, "a.b/..c": True}
    df = spark.createDataFrame([(p,) for p in safe], "p string")
    assert {r.p: r.s for r in df.select("p", P.safe_relative(F.col("p")).alias("s")).collect()} == safe
    df = spark.createDataFrame([("src/a/b.ts",)], "p string")
    assert df.select(*[F.col("p").rlike(P.glob(g)) for g in ("src", "src/**", "src/*/b.ts", "src/*.ts", "a")]).first()[:] == (True, True, True, False, False)


@pytest.mark.parametrize("p,bad", [((0.97, 0.01, 0.01, 0.01), []), ((0.97, 0.06, 0.0, 0.0), ["total"]), ((0.96, 0.02, 0.0, 0.0), []), ((0.2, 0.8, 0.0, 0.0), ["maximum"]), ((1.2, -0.2, 0.0, 0.0), ["probability"])])
def test_answers_are_checked(spark, p, bad):
    m = F.create_map(*[x for label, v in zip(A.DEFECT_LABELS, p) for x in (F.lit(label), F.lit(v))])
    labels = F.array(*[F.lit(x) for x in A.DEFECT_LABELS])
    row = spark.range(1).select(A.violations(F.lit("not_applicable"), F.lit(0.5), m, labels).alias("ok"), A.violations(F.lit("other"), F.lit(2.0), m, labels).alias("no"), A.violations(F.lit(None).cast("string"), F.lit(None).cast("double"), m, labels).alias("null")).first()
    assert row.ok == bad and {"choice", "confidence"} <= set(row.no) and {"choice", "confidence"} <= set(row.null)


def test_rubrics_and_request_keys(spark):
    kind = "map<string,struct<type:string,instructions:string,criteria:map<string,string>>>"
    defect = {"type": "choice", "instructions": "i", "criteria": dict.fromkeys(A.DEFECT_LABELS, "c")}
    presence = {"type": "choice", "instructions": "i", "criteria": dict.fromkeys(A.PRESENCE_LABELS, "c")}
    rubrics = [({"a": defect}, "defects"), ({"input_x": presence}, "classification"), ({"input_x": presence, "a": defect}, None), ({}, None), ({"x": presence}, None), ({"a": {**defect, "instructions": " "}}, None)]
    df = spark.createDataFrame([(json.dumps(r), w) for r, w in rubrics], "r string, want string").withColumn("m", F.from_json("r", kind))
    assert all(r.want == r.mode for r in df.select("want", A.rubric_mode(F.col("m")).alias("mode")).collect())
    parts = [["h", "id", "text", "q", "m"], ["hi", "d", "text", "q", "m"], ["h", "id", "text", None, "m"], ["h", "id", "textq", "", "m"]]
    keys = [spark.range(1).select(A.request_key(*[F.lit(x).cast("string") for x in p])).first()[0] for p in parts]
    assert len(set(keys)) == 4


def test_spans_with_and_without_blocks(spark):
    r = random.Random(5)
    spans = lambda n: spark.createDataFrame([(r.randint(0, 3), s, s + r.choice([0, 1, 5, 60]), i) for i in range(n) for s in [r.randint(0, 200)]], "f int, start int, end int, id int")
    a, b = spans(60), spans(60)
    for how, match in (("contains", lambda x, y: x.start <= y.start and x.end >= y.end), ("overlaps", lambda x, y: x.start <= y.end and x.end > y.start)):
        want = {(x.id, y.id) for x in a.collect() for y in b.collect() if x.f == y.f and match(x, y)}
        for bucket in (None, 7, 64):
            got = [tuple(z) for z in relations.span_join(a, b, "f", how, bucket).select("id", "r_id").collect()]
            assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 40), unique=True, max_size=30), st.integers(1, 7))
def test_pages_have_every_row_once(spark, ids, limit):
    rows = spark.createDataFrame([(i,) for i in ids], "id int")
    got = list(relations.pages(rows, "id", limit, ["id"], ahead=3))
    assert [r[0] for p in got for r in p] == sorted(ids) and all(len(p) <= limit for p in got)


def test_page_budget_and_cursors(spark):
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(5)], "id int, t string")
    page = relations.keyset_page(rows, "id", -1, 4, F.octet_length("t"), budget=25).collect()
    assert [r.id for r in page] == [0, 1] and page[0].has_more
    large = spark.createDataFrame([(1, "x" * 200), (2, "y")], "id int, t string")
    with pytest.raises(Exception, match="single_result_exceeds_budget"):
        relations.keyset_page(large, "id", 0, 4, F.octet_length("t"), budget=100).collect()
    assert [r.id for r in relations.keyset_page(large, "id", 1, 4, F.octet_length("t"), budget=100).collect()] == [2]
    c = relations.cursor("g1", ["callers", "f"], "k7")
    assert relations.after(c, "g1", ["callers", "f"], "") == "k7" and relations.after(None, "g1", ["x"], "") == ""
    for bad in ((c, "g2", ["callers", "f"], ""), (c, "g1", ["callers", "g"], ""), (c, "g1", ["callers", "f"], 0), ("x" * 5000, "g1", [], ""), ("!!", "g1", [], "")):
        with pytest.raises(relations.StaleCursor):
            relations.after(*bad)


def test_upserts_and_drift(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1), (3, "f", 2)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in relations.last_wins(old, new, ["k"], ["at"]).collect()) == [(1, "a"), (2, "d"), (3, "f")]
    assert sorted((r.k, r.v) for r in relations.first_wins(old, new, ["k"], ["at"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]
    assert [r.k for r in relations.delete_by(old, new, ["k"]).collect()] == [1]
    a, b = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, hash string"), spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, hash string")
    assert sorted(map(tuple, relations.drift(a, b).collect())) == [("w", "unexpected"), ("y", "changed"), ("z", "missing")]


def test_ranking_orders(spark):
    rows = [("b", "not_applicable", 0.1, 0.0, 0.0), ("a", "not_applicable", 0.1, 0.0, 0.0), ("c", "context_required", 0.2, 0.3, 0.9), ("d", "local_defect", 0.5, 0.4, 0.0), ("e", "local_defect", 0.5, 0.6, 0.0)]
    long = spark.createDataFrame([(i, "q", c, na, d, x) for i, c, na, d, x in rows], "id string, question string, choice string, p_na double, p_defect double, p_context double")
    ranked = scoring.rank(scoring.summarize(long, "id"), "id").collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r.review_rank)] == ["e", "d", "c", "a", "b"]
    assert [r.id for r in sorted(ranked, key=lambda r: r.relevance_rank)] == ["a", "b", "c", "d", "e"]
    big = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x int")
    assert all(r.rank == r.x + 1 for r in relations.global_rank(big, [F.asc("x")], "rank").collect())


def plan_rows(spark, n, files):
    subjects = spark.createDataFrame([(f"f{i:04d}", f"file{i % files}", "function", "application_candidate") for i in range(n)] + [("t1", "page", "template", "application_candidate"), ("v1", "lib", "function", "vendor")], "subject_id string, file string, kind string, purpose string")
    answers = spark.createDataFrame([(f"f{i:04d}", q, "present" if i % 2 else "unclear") for i in range(n) for q in (["operation_database_query", "input_caller_supplied"] if i % 3 else ["operation_cryptography"])], "subject_id string, question string, choice string")
    return subjects, answers, spark.createDataFrame([("file0",)], "file string")


def test_plan_is_reproducible_and_diverse(spark):
    s, a, routed = plan_rows(spark, 30, 2)
    full = planner.plan(s, a, routed).collect()
    by = {}
    for r in full:
        by.setdefault(r.subject_id, set()).add(r.theme)
    assert by["f0001"] == {"query-structure", "object-ownership"} and by["f0000"] == {"cryptography"} and by["t1"] == {"rendering-context"}
    assert {r.decision for r in full if r.subject_id == "v1"} == {"excluded"} and all(r.decision == "selected" for r in full if r.subject_id != "v1")
    one, two = (planner.plan(s, a, routed, maximum=10).where("decision = 'selected'").collect() for _ in range(2))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 10
    assert {r.file for r in one} >= {"file0", "file1"} and sum(r.theme == "control-sample" for r in one) == 2
    assert planner.plan(s, a, routed, maximum=4).where("theme = 'control-sample'").count() == 0
    with pytest.raises(ValueError):
        planner.plan(s, a, routed, maximum=0)


def test_queue_transitions(spark):
    schema = "id int, state string, role string, attempt string, deadline long, priority int, result string, error string"
    tasks = spark.createDataFrame([(i, "queued", "localizer", None, None, 5 - i, None, None) for i in range(4)], schema)
    claimed = lifecycle.claim(tasks, 2, now=100, timeout_ms=50)
    run = {r.id: r for r in claimed.where("state = 'running'").collect()}
    assert set(run) == {2, 3} and len({r.attempt for r in run.values()}) == 2
    assert lifecycle.claim(tasks, 2, 100, 50, calls=3, most_calls=3).where("state = 'running'").count() == 0
    results = spark.createDataFrame([(2, run[2].attempt, "supported_candidate", "r2"), (3, "old", "supported_candidate", "r3")], "id int, attempt string, disposition string, result string")
    done = {r.id: r for r in lifecycle.finish(claimed, results).collect()}
    assert (done[2].state, done[2].role, done[3].state) == ("queued", "investigator", "running")
    assert [r.id for r in lifecycle.stale(claimed, results).collect()] == [3]
    assert {r.id: r.state for r in lifecycle.recover(claimed, 151).collect()} == dict.fromkeys(range(4), "queued")
    failed = lifecycle.fail(claimed, spark.createDataFrame([(2, run[2].attempt, "timeout")], "id int, attempt string, error string"))
    attempts = spark.createDataFrame([(2, "localizer")] * 3 + [(3, "localizer")], "task_id int, role string")
    assert {r.id: r.state for r in lifecycle.retry_failed(failed, attempts).collect()}[2] == "failed"
    assert {r.id: r.state for r in lifecycle.retry_failed(failed, attempts.where("task_id = 3")).collect()}[2] == "queued"
    ended = spark.createDataFrame([(1, "completed", "challenger", "a", None, 1, "r", None)], schema)
    again = lifecycle.continue_inconclusive(ended, attempts, spark.createDataFrame([(1, "needs_context")], "task_id int, disposition string")).first()
    assert (again.state, again.role) == ("queued", "investigator")
    proposals = spark.createDataFrame([(1, "s", "cryptography"), (1, "s", "nonsense"), (2, "s", "cryptography")], "task_id int, subject_id string, theme string")
    parents = spark.createDataFrame([(2, 3)], "candidate_id int, depth int")
    assert sorted((r.task_id, r.depth, r.state) for r in lifecycle.follow_ups(proposals, parents, ["cryptography"]).collect()) == [(1, 1, "proposed"), (2, 4, "depth_limited")]


def test_recall_is_null_until_something_is_investigated(spark):
    cases = spark.createDataFrame([("positive", True, False, False), ("negative", True, True, True)], "expected string, selected boolean, investigated boolean, supported boolean")
    r = coverage.recall(cases).first()
    assert (r.selection_recall, r.detection_recall, r.conditional_detection_recall, r.false_positive_flags) == (1.0, None, None, 1)
    assert coverage.recall(cases.limit(0)).first().selection_recall is None


def test_files_and_json(spark, tmp_path):
    for name, text in {"a.ts": "x", "b/c.d.ts": "y", "node_modules/d.js": "z", "tests/e.mjs": "w", "secrets.json": "s", "f.bin": "q", "static/g.html": "<p>"}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    found = readers.files(spark, str(tmp_path / "src"))
    source, skipped = readers.inventory(found)
    assert [r.path for r in source.collect()] == ["a.ts", "tests/e.mjs"]
    assert {r.path: r.reason for r in skipped.collect()}["b/c.d.ts"] == "declaration"
    snap = {r.path: r for r in readers.snapshot(found).collect()}
    assert (snap["secrets.json"].reason, snap["node_modules/d.js"].reason, snap["f.bin"].reason) == ("private_file_policy", "generated_or_installed_directory", "unsupported_content_metadata_only")
    assert snap["static/g.html"].public and snap["static/g.html"].language == "template" and snap["tests/e.mjs"].purpose == "test_or_fixture" and snap["secrets.json"].content is None
    (tmp_path / "l.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}')
    assert readers.json_lines(spark, str(tmp_path / "l.json"), "a int, b string").count() == 2
    (tmp_path / "w.json").write_text('{"files": [{"a": 1, "b": "x"}, {"a": 2, "b": null}], "n": 3}')
    assert [tuple(r) for r in readers.json_array(spark, str(tmp_path / "w.json"), "a int, b string", "files").collect()] == [(1, "x"), (2, None)]
    sinks.write_generation(found.select("path"), str(tmp_path / "out"), "files", 3)
    assert readers.generation(spark, str(tmp_path / "out"), "files", 3).count() == 7
    new = sinks.put_artifacts(found.select(F.col("content").cast("string").alias("t")), "t", None, str(tmp_path / "art"))
    assert new.count() == 7 and sinks.put_artifacts(found.select(F.col("content").cast("string").alias("t")), "t", spark.read.parquet(str(tmp_path / "art")), str(tmp_path / "art2")).count() == 0
    assert sinks.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string"), ["x", "y"]).first().value == "| a&#124;b |  |"
    assert readers.sql(spark, "SELECT :a + 1 AS x", a=2).first().x == 3


def test_streams(spark, tmp_path):
    from lodestone.streaming import queue

    spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:10:00")], "user int, time string").selectExpr("user", "cast(time as timestamp) as time").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("user int, time timestamp").parquet(str(tmp_path / "in"))
    q = queue.first_seen(events, ["user"], "time", "1 hour").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r["count"] for r in queue.windowed_counts(batch, "time", "5 minutes", "1 hour", "user").collect()) == [1, 2]
    assert sorted(r.events for r in queue.active_time(batch, "user", "time", "1 minute").collect()) == [1, 2]


def test_ordered_digest_is_a_tree(spark):
    """A group is spread over ranges and nodes of FAN; the root is that of the same tree by loops."""
    import hashlib

    from lodestone.operators import relations

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, 'b', if(id % 10 = 1, null, if(id = 2, 'one', 'a'))) AS g", "id", "concat('t', id) AS t").repartition(5, "id")

    def root(level):
        while True:
            level = [sha("".join(level[i : i + relations.FAN])) for i in range(0, len(level), relations.FAN)]
            if len(level) == 1:
                return level[0]

    want = {}
    for i in range(20_000):
        want.setdefault({0: "b", 1: None}.get(i % 10, "one" if i == 2 else "a"), []).append(sha(f"{i}\x1ft{i}"))
    done = relations.ordered_digest(rows, ["id"], ["id", "t"], ["g"])
    assert {r.g: r.fingerprint for r in done.collect()} == {k: root(v) for k, v in want.items()} and done.count() == 4
    assert relations.ordered_digest(rows.limit(0), ["id"], ["id"], ["g"]).count() == 0
    whole = [sha(f"{i}") for i in range(20_000)]
    assert [tuple(r) for r in relations.ordered_digest(rows, ["id"], ["id"]).collect()] == [(root(whole),)]
    assert [tuple(r) for r in relations.ordered_digest(rows.limit(0), ["id"], ["id"]).collect()] == [(sha(""),)]


def test_tree_difference_reads_only_what_differs(spark):
    a = spark.range(3000).selectExpr("concat('f', id) AS path", "sha2(cast(id AS string), 256) AS hash")
    b = a.where("path not in ('f7', 'f8')").selectExpr("path", "if(path = 'f9', 'x', hash) AS hash").union(spark.createDataFrame([("new", "h"), ("nul", None)], "path string, hash string"))
    trees = [relations.digest_tree(x, "path", "hash", levels=2) for x in (a, b)]
    got = sorted(map(tuple, relations.tree_drift(*trees, "path", "hash").collect()))
    assert got == sorted(map(tuple, relations.drift(a, b).collect())) == [("f7", "missing"), ("f8", "missing"), ("f9", "changed"), ("new", "unexpected"), ("nul", "unexpected")]
    same = relations.tree_drift(trees[0], relations.digest_tree(a.repartition(5), "path", "hash", levels=2), "path", "hash")
    assert same.count() == 0
    assert trees[0][0].where("level = 0").count() == 1 and trees[0][0].where("level = 2").count() <= 256


def test_ranks_need_no_single_task(spark):
    """A group with most rows, nulls as a group, and no window without a bounded partition over the rows."""
    r = random.Random(5)
    rows = [(i, r.choice(["a"] * 8 + ["b", None]), r.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, p int").repartition(6)
    ranked = relations.global_rank(df, [F.desc("p"), F.asc("id")], "n")
    got = {x.id: (x.n, x.m) for x in relations.grouped_rank(ranked, ["g"], [F.asc("p"), F.asc("id")], "m", most=100).collect()}
    assert got == {x.id: (x.n, x.m) for x in relations.grouped_rank(ranked, ["g"], [F.asc("p"), F.asc("id")], "m").collect()}
    order = sorted(rows, key=lambda x: (-x[2], x[0]))
    assert all(got[x[0]][0] == k for k, x in enumerate(order, 1))
    for g in ("a", "b", None):
        assert [got[x[0]][1] for x in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))] == list(range(1, sum(x[1] == g for x in rows) + 1))
    assert relations.global_rank(df.limit(0), [F.asc("id")], "n").count() == 0


def test_offsets_of_hits_and_lines(spark):
    rows = [(1, "a\n\nbc"), (2, ""), (3, "aaaa"), (4, "x" + "ab" * 5000), (4, "ab"), (5, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    found = sorted((x.id, x.start, x.end) for x in relations.hits(df, ["id"], F.col("t"), F.lit("aa")).collect())
    assert found == [(3, 0, 2), (3, 2, 4)]
    assert sorted(x.start for x in relations.hits(df, ["id"], F.col("t"), F.lit("ab")).collect()) == sorted([0, *range(1, 10_001, 2)])
    assert sorted((x.id, x.line, x.start, x.end) for x in relations.text_lines(df.where("id < 4"), ["id"], F.col("t")).collect()) == [(1, 1, 0, 1), (1, 2, 2, 2), (1, 3, 3, 5), (2, 1, 0, 0), (3, 1, 0, 4)]
    with pytest.raises(ValueError):
        relations.search(df, "t", "t", "ab")


def test_paths_from_folders(spark):
    df = spark.createDataFrame([("a/b/c.ts", "a/x", "../b/c.ts"), ("a", "", "a"), ("a/b", "a/b", ""), ("b", "a/c", "../../b")], "p string, d string, want string")
    for x in df.select("p", "want", P.relative(F.col("p"), F.col("d")).alias("r"), P.ancestors(F.col("p")).alias("up")).collect():
        assert x.r == x.want and x.up == ["/".join(x.p.split("/")[:k]) for k in range(x.p.count("/") + 1)]


def test_output_of_another_run_is_refused(spark, tmp_path):
    from lodestone.sources import dataset

    run = {"root": "/r", "model": "m", "questionsHash": "q", "sanitizerVersion": "1", "mode": "defects"}
    for _ in range(2):
        dataset.claim_output(spark, str(tmp_path / "out"), run)
    for other in ({"model": "n"}, {"mode": "classification"}, {"root": "/s"}):
        with pytest.raises(ValueError):
            dataset.claim_output(spark, str(tmp_path / "out"), run | other)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "summary.json").write_text(json.dumps({k: v for k, v in run.items() if k != "mode"} | {"model": "older"}))
    with pytest.raises(ValueError):
        dataset.claim_output(spark, str(tmp_path / "old"), run)


def test_datasets_are_checked_and_imported_once(spark, tmp_path):
    import hashlib

    from lodestone.sources import dataset

    sha = lambda b: hashlib.sha256(b).hexdigest()
    content = {"a.ts": b"export function f() {}", "b/c.ts": b"x"}
    files = lambda d: spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in d.items()], "path string, bytes long, content binary")
    own = {"inventory.json": b"{}", "functions.jsonl": b"{}"}
    manifest = spark.createDataFrame([(p, sha(b), len(b)) for p, b in own.items()], "path string, sha256 string, bytes long")
    inventory = spark.createDataFrame([(p, sha(b)) for p, b in content.items()], "file string, sourceHash string")
    functions = spark.createDataFrame([("f1", "a.ts"), ("f2", "b/c.ts")], "id string, file string")
    answers = spark.createDataFrame([("f1", "q", "present"), ("f2", "q", "absent")], "function_id string, question string, choice string")
    good = dict(manifest=manifest, dataset=files(own), source=files(content), inventory=inventory, functions=functions, answers=answers)
    wrong = lambda **x: {r.problem for r in dataset.violations(**(good | x)).collect()}
    assert wrong() == set()
    assert wrong(manifest=manifest.where("path != 'inventory.json'")) == {"missing_artifact_descriptor"}
    assert wrong(dataset=files(own | {"functions.jsonl": b"[]"})) == {"dataset_hash_mismatch"} and wrong(source=files({"a.ts": content["a.ts"]})) == {"source_hash_mismatch"}
    assert wrong(answers=answers.where("function_id = 'f1'")) == {"function_without_answers"} and wrong(functions=functions.where("id = 'f1'")) == {"answers_without_function"}
    assert wrong(functions=functions.union(functions)) == {"repeated_function"}
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="source_hash_mismatch"):
        dataset.import_dataset(root, 1, **(good | {"source": files({})}))
    with pytest.raises(ValueError, match="size_limit"):
        dataset.import_dataset(root, 1, **good, limit=3)
    assert [dataset.import_dataset(root, 1, **good) for _ in range(2)] == ["imported", "already_imported"]
    assert readers.generation(spark, root, "functions", 1).count() == 2 and dataset.meta(readers.generation(spark, root, "meta", 1), "datasetId")
    with pytest.raises(ValueError, match="different_dataset"):
        dataset.import_dataset(root, 1, **(good | {"manifest": manifest.limit(1)}))


def test_hidden_files_and_links_are_omitted_with_a_reason(spark):
    found = spark.createDataFrame([("a.ts", 1, bytearray(b"x")), ("public/x.bin", 1, bytearray(b"y"))], "path string, bytes long, content binary")
    taken = readers.snapshot(found)
    listed = spark.createDataFrame([("a.ts", "file"), (".env", "file"), ("l.ts", "link"), (".eslintrc.json", "file")], "path string, kind string")
    assert {r.path: r.reason for r in readers.omissions(taken, listed).collect()} == {"public/x.bin": "unsupported_content_metadata_only", ".env": "private_file_policy", "l.ts": "symbolic_link", ".eslintrc.json": "hidden_from_reader"}
    assert not any(r.public for r in taken.where("reason is not null").collect())


def test_bench_picks_its_queries():
    import bench

    assert bench.selected(dict.fromkeys(["operation_groups", "op10_b", "op2_a", "pipeline", "plan_full", "opera"])) == ["plan_full", "operation_groups", "op2_a", "op10_b", "pipeline"]


def test_ranks_of_many_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(relations, "TASK_ROWS", 10)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 40).cast("string").alias("file"), F.lit("t").alias("theme"), F.lit(5).cast("long").alias("priority"), F.lpad("id", 3, "0").alias("rank"), F.lit("deferred").alias("decision"))
    assert relations.row_parts(100, spark) == max(n, 10) > n
    seen = []
    frame = type(rows)
    for name in ("repartition", "repartitionByRange"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name): seen.append(a[0]) or f(self, *a))
    got = {r.id: r.priority for r in planner.diversify(rows).collect()}
    assert got == {str(i): 5 + (i // 40) * 20 + i * 4 for i in range(100)} and seen == [10, 10]
