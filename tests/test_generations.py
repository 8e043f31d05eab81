"""Publishing at once, with failed, late and racing writers; batches that run twice."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import relations
from lodestone.plans import coordinator, event_log, lifecycle
from lodestone.sources.generations import Conflict, Generations
from lodestone.streaming.incremental import Index


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_readers_see_all_tables_or_none(spark, tmp_path):
    store = Generations(spark, str(tmp_path))
    assert store.latest() is None
    first = store.publish({"a": rows(spark, 1, 2), "b": rows(spark, 3)}, None, {"by": "x"})
    assert (first.number, first.tables, store.latest().details) == (1, ("a", "b"), {"by": "x"})
    broken = rows(spark, 1).select(F.raise_error(F.lit("broken")).cast("int").alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.publish({"a": rows(spark, 9), "b": broken}, first)
    assert store.latest() == first and ids(store.table(first, "a")) == [1, 2] and ids(store.table(first, "b")) == [3]
    with pytest.raises(KeyError):
        store.table(first, "c")
    assert len(store.vacuum()) == 1 and store.names("writing") == []
    assert ids(store.table(store.latest(), "a")) == [1, 2]


def test_a_late_writer_is_refused(spark, tmp_path):
    store, other = Generations(spark, str(tmp_path)), Generations(spark, str(tmp_path))
    seen = store.publish({"a": rows(spark, 1)}, None)
    second = other.publish({"a": rows(spark, 2)}, seen)
    with pytest.raises(Conflict):
        store.publish({"a": rows(spark, 3)}, seen)
    assert store.latest() == second and ids(store.table(second, "a")) == [2]
    third = store.publish({"a": rows(spark, 3)}, store.latest())
    assert third.number == 3 and ids(store.table(store.latest(), "a")) == [3]
    assert not store.create("published/000000000003", "{}")
    (tmp_path / "published" / "000000000004").write_text("")  # a pointer that is being written
    assert store.latest() == third


def test_pins_keep_what_is_read(spark, tmp_path):
    store = Generations(spark, str(tmp_path))
    first = store.publish({"a": rows(spark, 1)}, None)
    with store.pinned() as pinned:
        second = store.publish({"a": rows(spark, 2)}, first)
        assert pinned == first and store.vacuum() == [] and ids(store.table(pinned, "a")) == [1]
    store.create("writing/alive", "")
    rows(spark, 5).write.parquet(f"{tmp_path}/tables/a/generation=alive")
    assert store.vacuum() == [first.generation]
    assert store.numbers() == [2] and ids(store.table(second, "a")) == [2] and "generation=alive" in store.names("tables/a")
    with pytest.raises(LookupError):
        with store.pinned(1):
            pass


FILES = "file string, hash string, content string"


def calls(files):
    return relations.hits(files, ["file", "hash"], F.col("content"), F.lit("call")).select("file", "start")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_batches_that_run_twice_change_nothing(spark, tmp_path):
    index = Index(str(tmp_path), "g1", calls)
    one = spark.createDataFrame([("a", "1", "call call"), ("b", "1", "none"), ("x", None, None)], FILES)
    two = spark.createDataFrame([("a", "1", "call call"), ("c", "1", "call"), ("c", "1", "call")], FILES)
    index.process(one, 0)
    once = found(index.rows(spark)), found(index.commits(spark))
    index.process(one, 0)
    assert (found(index.rows(spark)), found(index.commits(spark))) == once
    index.process(two, 1)
    index.process(two, 1)
    assert found(index.rows(spark)) == [("a", 0), ("a", 5), ("c", 0)]
    snapshot = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "file string, hash string")
    assert index.stats(spark, snapshot).first().asDict() == {"reused": 1, "reused_from_previous": 0, "parsed": 3, "unavailable": 1, "incomplete": 1}

    later = Index(str(tmp_path), "g2", calls, previous="g1")
    batch = spark.createDataFrame([("a", "1", None), ("c", "2", "call call"), ("x", "1", "call")], FILES)
    later.process(batch, 0)
    assert found(later.rows(spark)) == [("a", 0), ("a", 5), ("c", 0), ("c", 5), ("x", 0)]
    assert {r.file: r.action for r in later.commits(spark).collect()} == {"a": "reused_from_previous", "c": "parsed", "x": "parsed"}
    with pytest.raises(ValueError):
        Index(str(tmp_path), "g1", calls, previous="g1")


def test_a_batch_that_fails_half_way_is_not_read(spark, tmp_path):
    index = Index(str(tmp_path), "g", calls)
    batch = spark.createDataFrame([("a", "1", "call")], FILES)
    calls(batch).write.parquet(index.folder("rows", "g", 7))  # rows, but no commits
    assert index.rows(spark).count() == 0 and index.commits(spark).count() == 0
    index.process(batch, 7)
    assert found(index.rows(spark)) == [("a", 0)]


def test_as_a_stream(spark, tmp_path):
    index = Index(str(tmp_path / "index"), "g", calls)
    for n, data in enumerate([[("a", "1", "call")], [("a", "1", "call"), ("b", "1", "callcall")]]):
        spark.createDataFrame(data, FILES).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # resumes, and finds nothing new
        query = stream.writeStream.foreachBatch(index.process).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert found(index.rows(spark)) == [("a", 0), ("b", 0), ("b", 4)]


TASKS = "id string, state string, role string, attempt string, deadline long, result string, error string, priority int"
ATTEMPTS, EVENTS = "id string, task_id string, role string, started long", "task_id string, sequence long, kind string, attempt string, at long, deadline long"


def queue(spark, path, n):
    store = Generations(spark, str(path))
    tasks = spark.createDataFrame([(f"t{i}", "queued", "localizer", None, None, None, None, i) for i in range(n)], TASKS)
    store.publish({"tasks": tasks, "attempts": spark.createDataFrame([], ATTEMPTS), "events": spark.createDataFrame([], EVENTS), "other": rows(spark, 1)}, None)
    return store


def test_two_coordinators_never_claim_a_task_twice(spark, tmp_path):
    store = queue(spark, tmp_path, 4)
    raced = []

    def slow(tables):
        """Another coordinator claims while this one works out its own change."""
        if not raced:
            raced.append(coordinator.claim(Generations(spark, str(tmp_path)), 2, 100, 50))
        return {"tasks": lifecycle.claim(tables["tasks"], 1, 200, 50)}

    done = coordinator.transition(store, slow)
    assert done.number == 3 and store.latest() == done
    claimed = {r.id: r.deadline for r in store.table(done, "tasks").where("state = 'running'").collect()}
    assert claimed == {"t0": 150, "t1": 150, "t2": 250}
    assert ids(store.table(done, "other")) == [1] and store.names("pins") == []
    with pytest.raises(Conflict):
        coordinator.transition(store, lambda tables: {"tasks": store.publish({"tasks": tables["tasks"]}, store.latest()) and tables["tasks"]}, tries=1)


def test_claims_leave_attempts_and_events(spark, tmp_path):
    store = queue(spark, tmp_path, 5)
    coordinator.claim(store, 2, 100, 50, most_calls=3)
    done = coordinator.claim(store, 2, 200, 50, most_calls=3)  # the budget leaves one
    tries = sorted((r.task_id, r.role, r.started) for r in store.table(done, "attempts").collect())
    assert tries == [("t0", "localizer", 100), ("t1", "localizer", 100), ("t2", "localizer", 200)]
    said = store.table(done, "events")
    assert sorted((r.sequence, r.task_id, r.deadline) for r in said.collect()) == [(1, "t0", 150), (2, "t1", 150), (3, "t2", 250)]
    tasks = store.table(done, "tasks")
    more = said.selectExpr("*", "cast(null as string) disposition", "cast(null as string) result", "cast(null as string) error")
    folded = event_log.fold(tasks.select("id"), more).select("id", "state", "role", "attempt", "deadline")
    assert found(folded) == found(tasks.select("id", "state", "role", "attempt", "deadline"))
