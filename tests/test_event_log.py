"""The fold of the event log against the transitions one by one, and against a plain state machine."""

import random

from pyspark.sql import functions as F

from lodestone.operators import relations, scoring
from lodestone.plans import coverage, event_log, lifecycle

EVENTS = "task_id string, sequence long, kind string, attempt string, at long, deadline long, disposition string, result string, error string"
TASKS = "id string, state string, role string, attempt string, deadline long, result string, error string"


def plain(events):
    s = {"state": "queued", "role": "localizer", "attempt": None, "deadline": None, "result": None, "error": None}
    said, tries, stale = None, [], []
    for _, sequence, kind, attempt, at, deadline, disposition, result, error in sorted(events, key=lambda e: e[1]):
        own = s["state"] == "running" and s["attempt"] == attempt
        count = lambda role: sum(t[1] == role for t in tries)
        back = "investigator" if s["role"] == "challenger" else s["role"]
        if kind == "claimed" and s["state"] == "queued":
            tries.append([attempt, s["role"], at, None, "running", None])
            s |= {"state": "running", "attempt": attempt, "deadline": deadline}
        elif kind == "result" and own:
            tries[-1][3:] = [at, "completed", result]
            ends = s["role"] == "challenger" or disposition in lifecycle.TERMINAL
            said = disposition
            s |= {"state": "completed" if ends else "queued", "role": s["role"] if ends else ("investigator" if s["role"] == "localizer" else "challenger"), "deadline": None, "result": result, "error": None}
        elif kind == "failed" and own:
            tries[-1][3:5] = [at, "failed"]
            s |= {"state": "failed", "deadline": None, "error": error}
        elif kind == "expired" and own and s["deadline"] < at:
            tries[-1][3:5] = [at, "expired"]
            s |= {"state": "queued", "attempt": None, "deadline": None, "error": "expired_attempt"}
        elif kind == "retried" and s["state"] == "failed" and count(s["role"]) < 3:
            s |= {"state": "queued", "attempt": None, "error": None}
        elif kind == "continued" and s["state"] == "completed" and said in lifecycle.INCONCLUSIVE and count(back) < 3:
            s |= {"state": "queued", "role": back, "attempt": None, "error": None}
        else:
            stale.append(sequence)
    return s, [tuple(t) for t in tries], stale


def logs(seed, n):
    r = random.Random(seed)
    events = []
    for task in range(n):
        at = 0
        for k in range(r.randint(0, 25)):
            at += r.randint(1, 50)
            kind = r.choice(["claimed", "claimed", "claimed", "result", "result", "result", "failed", "expired", "retried", "continued"])
            name = f"{task}-{r.randint(max(0, k - 3), k)}" if kind != "claimed" else f"{task}-{k}"
            known = [e for e in events if e[0] == str(task) and e[2] == "claimed"]
            attempt = r.choice([name, known[-1][3] if known else name, known[-1][3] if known else name])
            events.append((str(task), 1000 * task + k, kind, attempt, at, at + 60 if kind == "claimed" else None, r.choice(["supported_candidate", "needs_context", "budget_exhausted", "refuted_hypothesis"]), f"r{k}", f"e{k}"))
    return events


def test_fold_equals_a_state_machine(spark):
    events = logs(3, 120)
    shuffled = spark.createDataFrame(random.Random(1).sample(events, len(events)), EVENTS).repartition(5)
    tasks = spark.createDataFrame([(str(i),) for i in range(121)], "id string")
    done = event_log.fold(tasks, shuffled).cache()
    found = {r.id: r for r in done.collect()}
    tries, stale = {}, {}
    for a in event_log.attempts(done).collect():
        tries.setdefault(a.task_id, []).append((a.id, a.role, a.started, a.finished, a.state, a.result))
    for x in event_log.stale(done).collect():
        stale.setdefault(x.task_id, []).append(x.sequence)
    for i in range(121):
        state, attempts, late = plain([e for e in events if e[0] == str(i)])
        assert {c: found[str(i)][c] for c in state} == state, i
        assert tries.get(str(i), []) == attempts and stale.get(str(i), []) == late
    assert found["120"].state == "queued"


def test_fold_equals_the_transitions(spark):
    """claim, finish, fail and recover as tables, step by step, log the events whose fold is their last state."""
    r = random.Random(8)
    tasks = spark.createDataFrame([(str(i), "queued", "localizer", None, None, None, None) for i in range(6)], TASKS).withColumn("priority", F.col("id").cast("int"))
    events, now, sequence = [], 0, 0
    for _ in range(5):
        now += 100
        before = {x.id: x for x in tasks.collect()}
        tasks = spark.createDataFrame(lifecycle.claim(tasks, 3, now, 150).collect(), tasks.schema)
        for x in tasks.collect():
            if x.state == "running" and before[x.id].state != "running":
                sequence += 1
                events.append((x.id, sequence, "claimed", x.attempt, now, x.deadline, None, None, None))
        running = [x for x in tasks.collect() if x.state == "running"]
        kinds = {x.id: r.choice(["result", "failed", "stale", "none"]) for x in running}
        results = [(x.id, x.attempt if kinds[x.id] == "result" else "other", r.choice(["supported_candidate", "refuted_hypothesis"]), "art") for x in running if kinds[x.id] in ("result", "stale")]
        errors = [(x.id, x.attempt, "err") for x in running if kinds[x.id] == "failed"]
        for i, attempt, disposition, result in results:
            sequence += 1
            events.append((i, sequence, "result", attempt, now + 1, None, disposition, result, None))
        for i, attempt, error in errors:
            sequence += 1
            events.append((i, sequence, "failed", attempt, now + 2, None, None, None, error))
        tasks = lifecycle.finish(tasks, spark.createDataFrame(results, "id string, attempt string, disposition string, result string"))
        tasks = lifecycle.fail(tasks, spark.createDataFrame(errors, "id string, attempt string, error string"))
        tasks = spark.createDataFrame(tasks.collect(), TASKS + ", priority int")
        for x in tasks.collect():
            if x.state == "running" and x.deadline < now + 60:
                sequence += 1
                events.append((x.id, sequence, "expired", x.attempt, now + 60, None, None, None, None))
        tasks = spark.createDataFrame(lifecycle.recover(tasks, now + 60).collect(), TASKS + ", priority int")
    done = event_log.fold(tasks.select("id"), spark.createDataFrame(events, EVENTS))
    columns = ["id", "state", "role", "attempt", "deadline", "result"]
    assert sorted(map(tuple, done.select(*columns).collect())) == sorted(map(tuple, tasks.select(*columns).collect()))


def plain_page(files, calls, after, limit, most_files, most_examined):
    file, ordinal = after or ("", -1)
    rows, last, examined, seen = [], after, 0, 0
    for f in sorted(files):
        if f < file:
            continue
        if seen >= most_files:
            return rows, last, examined, False
        seen += 1
        for o, hit in sorted(calls.get(f, [])):
            if f == file and o <= ordinal:
                continue
            if examined >= most_examined or len(rows) >= limit:
                return rows, last, examined, False
            examined, last = examined + 1, (f, o)
            if hit:
                rows.append((f, o))
        last = (f, (1 << 31) - 1)
    return rows, None, examined, True


def test_pages_with_work_caps(spark):
    r = random.Random(4)
    files = [f"f{i:02}" for i in range(17)]
    calls = {f: [(o, r.random() < 0.3) for o in range(r.choice([0, 0, 1, 5, 14]))] for f in files}
    table = spark.createDataFrame([(f, o, h) for f, cs in calls.items() for o, h in cs], "file string, ordinal int, m boolean")
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    after, found, pages = None, [], 0
    while True:
        page = relations.capped_page(listed, table, F.col("m"), after, 4, most_files=3, most_examined=11).collect()
        rows, last, examined, exhausted = plain_page(files, calls, after, 4, 3, 11)
        assert sorted((x.file, x.ordinal) for x in page if x.hit) == rows and (page[0].examined, page[0].exhausted) == (examined, exhausted)
        found, pages = found + rows, pages + 1
        if page[0].exhausted:
            break
        after = (page[0].next_file, page[0].next_ordinal)
        assert after == last
    assert found == [(f, o) for f in files for o, h in calls[f] if h] and pages > 5
    assert relations.capped_page(listed.limit(0), table.limit(0), F.col("m"), None, 4).first().exhausted


def test_a_page_is_the_same_however_calls_of_one_place_are_dealt(spark):
    files = spark.createDataFrame([("f",)], "file string")
    rows = [("f", 1, True, "c"), ("f", 2, True, "b"), ("f", 2, False, "z"), ("f", 2, True, "a"), ("f", 3, False, "y")]
    for r in (rows, rows[::-1], rows[2:] + rows[:2]):
        page = relations.capped_page(files, spark.createDataFrame(r, "file string, ordinal int, m boolean, name string").coalesce(1), F.col("m"), None, 2).collect()
        assert sorted((x.ordinal, x.name) for x in page) == [(1, "c"), (2, "a"), (2, "z")] and page[0].examined == 3


def test_uncertain_results_and_the_rubrics_order(spark):
    tasks = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "queued")], "id int, state string")
    results = spark.createDataFrame([(1, "needs_context", None), (2, "supported_candidate", "k"), (3, "budget_exhausted", None)], "task_id int, disposition string, operation_key string")
    out = coverage.coverage_summary({"tasks": tasks, "task_results": results})["execution"].first()
    assert (out.outstanding, out.unresolved_completed, out.queue_drained) == (1, 1, False)
    long = spark.createDataFrame([(1, q, "present") for q in ("b", "c", "a", "z")], "id int, question string, choice string")
    assert scoring.classify(long, "id", ["c", "a"]).first().present_categories == "c,a,b,z"
    assert scoring.classify(long, "id").first().present_categories == "a,b,c,z"
