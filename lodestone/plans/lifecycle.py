"""The task queue as transitions over tables: each function takes the state and returns the next; a coordinator writes it as a new generation.

A claim is fenced: results count only while the task still runs the attempt they belong to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles in order, and the results that end a task at any of them.
ROLES = ("localizer", "investigator", "challenger")
TERMINAL = ("no_relevant_operation", "refuted_hypothesis", "budget_exhausted")
INCONCLUSIVE = ("needs_context", "budget_exhausted")
MOST_ATTEMPTS, MOST_DEPTH = 3, 3


def next_role(role: Column) -> Column:
    return F.when(role == "localizer", "investigator").otherwise("challenger")


def claim(tasks: DataFrame, n: int, now: int, timeout_ms: int, calls: int = 0, most_calls: int | None = None) -> DataFrame:
    """tasks with the first n queued ones, by priority and id, running under a fresh attempt; none beyond the budget of calls."""
    n = n if most_calls is None else max(0, min(n, most_calls - calls))
    taken = tasks.where("state = 'queued'").orderBy("priority", "id").limit(n).select(F.col("id").alias("_id"))
    mark = F.col("_id").isNotNull()
    attempt = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("role"), F.lit(str(now))), 256)
    out = tasks.join(taken, F.col("id") == F.col("_id"), "left")
    return (
        out.withColumn("attempt", F.when(mark, attempt).otherwise(F.col("attempt")))
        .withColumn("deadline", F.when(mark, F.lit(now + timeout_ms)).otherwise(F.col("deadline")))
        .withColumn("state", F.when(mark, "running").otherwise(F.col("state")))
        .drop("_id")
    )


def finish(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """tasks after results (id, attempt, disposition, result). Results of another attempt, or of a task that doesn't run, are stale and
    change nothing; see `stale`."""
    r = results.select(F.col("id").alias("_id"), F.col("attempt").alias("_a"), "disposition", F.col("result").alias("_r"))
    out = tasks.join(r, (F.col("id") == F.col("_id")) & (F.col("attempt") == F.col("_a")) & (F.col("state") == "running"), "left")
    hit = F.col("_id").isNotNull()
    ends = (F.col("role") == "challenger") | F.col("disposition").isin(*TERMINAL)
    state = F.when(hit, F.when(ends, "completed").otherwise("queued")).otherwise(F.col("state"))
    role = F.when(hit & ~ends, next_role(F.col("role"))).otherwise(F.col("role"))
    deadline = F.when(hit, None).otherwise(F.col("deadline"))
    result = F.when(hit, F.col("_r")).otherwise(F.col("result"))
    return out.select(*[{"state": state, "role": role, "deadline": deadline, "result": result}.get(c, F.col(c)).alias(c) for c in tasks.columns])


def stale(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The results that finish() doesn't take."""
    running = tasks.where("state = 'running'").select("id", "attempt")
    return results.join(running, ["id", "attempt"], "left_anti")


def fail(tasks: DataFrame, errors: DataFrame) -> DataFrame:
    """tasks with those whose running attempt is in errors (id, attempt, error) failed."""
    e = errors.select(F.col("id").alias("_id"), F.col("attempt").alias("_a"), F.col("error").alias("_e"))
    out = tasks.join(e, (F.col("id") == F.col("_id")) & (F.col("attempt") == F.col("_a")) & (F.col("state") == "running"), "left")
    hit = F.col("_id").isNotNull()
    new = {"state": F.when(hit, "failed").otherwise(F.col("state")), "error": F.when(hit, F.col("_e")).otherwise(F.col("error")), "deadline": F.when(hit, None).otherwise(F.col("deadline"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in tasks.columns])


def recover(tasks: DataFrame, now: int) -> DataFrame:
    """tasks with running ones whose deadline has passed queued again."""
    late = (F.col("state") == "running") & (F.col("deadline") < now)
    new = {"state": F.lit("queued"), "attempt": F.lit(None), "deadline": F.lit(None), "error": F.lit("expired_attempt")}
    return tasks.select(*[F.when(late, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])


def attempts_below(tasks: DataFrame, attempts: DataFrame, role: Column) -> DataFrame:
    """tasks with _left: whether they have had less than MOST_ATTEMPTS attempts in a role."""
    n = attempts.groupBy(F.col("task_id").alias("_t"), F.col("role").alias("_role")).agg(F.count(F.lit(1)).alias("_n"))
    return tasks.join(n, (F.col("id") == F.col("_t")) & (role == F.col("_role")), "left").withColumn("_left", F.coalesce("_n", F.lit(0)) < MOST_ATTEMPTS).drop("_t", "_role", "_n")


def retry_failed(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    again = (F.col("state") == "failed") & F.col("_left")
    new = {"state": F.lit("queued"), "attempt": F.lit(None), "error": F.lit(None)}
    out = attempts_below(tasks, attempts, F.col("role"))
    return out.select(*[F.when(again, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])


def continue_inconclusive(tasks: DataFrame, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """tasks with completed ones of an inconclusive result queued again; a challenger's go back to the investigator."""
    back = F.when(F.col("role") == "challenger", "investigator").otherwise(F.col("role"))
    open_ = results.where(F.col("disposition").isin(*INCONCLUSIVE)).select(F.col("task_id").alias("_open")).distinct()
    out = attempts_below(tasks, attempts, back).join(open_, F.col("id") == F.col("_open"), "left")
    again = (F.col("state") == "completed") & F.col("_left") & F.col("_open").isNotNull()
    new = {"state": F.lit("queued"), "attempt": F.lit(None), "error": F.lit(None), "role": back}
    return out.select(*[F.when(again, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])


def follow_ups(proposals: DataFrame, parents: DataFrame, known_themes) -> DataFrame:
    """Proposals (task_id, subject_id, theme, operation, rationale) as follow-ups one deeper than their parent; those too deep are marked."""
    depth = parents.groupBy(F.col("candidate_id").alias("_c")).agg(F.max("depth").alias("_d"))
    out = proposals.where(F.col("theme").isin(*known_themes)).join(depth, F.col("task_id") == F.col("_c"), "left").withColumn("depth", F.coalesce("_d", F.lit(0)) + 1)
    return out.withColumn("state", F.when(F.col("depth") > MOST_DEPTH, "depth_limited").otherwise("proposed")).drop("_c", "_d")


def approve(followups: DataFrame, ids: Sequence[str], candidates: DataFrame, results: DataFrame, known_themes: Sequence[str], most: int = 100) -> DataFrame:
    """id, candidate_id, action of the chosen follow-ups (id, subject_id, operation_key, start, end, theme, depth, state): rejected where one isn't proposed, too deep or of
    an unknown theme; known where a candidate (candidate_id, theme, subject_id, start, end) of its theme and subject has the same span or a result (task_id, operation_key) for
    the same operation, of which the first by id counts; else admitted. The OR of the two ways is two equi-joins."""
    if not ids or len(ids) > most or len(set(ids)) != len(ids):
        raise ValueError(f"1 to {most} different follow-ups are approved at once")
    chosen = followups.where(F.col("id").isin(*ids))
    c = candidates.select(F.col("candidate_id").alias("_c"), F.col("theme").alias("_theme"), F.col("subject_id").alias("_subject"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = (F.col("theme") == F.col("_theme")) & (F.col("subject_id") == F.col("_subject"))
    by_span = chosen.join(c, same & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end"))).select("id", "_c")
    done = c.join(results.select(F.col("task_id").alias("_c"), F.col("operation_key").alias("_key")), "_c")
    by_key = chosen.join(done, same & (F.col("operation_key") == F.col("_key"))).select("id", "_c")
    known = by_span.unionByName(by_key).groupBy("id").agg(F.min("_c").alias("candidate_id"))
    good = (F.col("state") == "proposed") & (F.col("depth") <= MOST_DEPTH) & F.col("theme").isin(*known_themes)
    action = F.when(~F.coalesce(good, F.lit(False)), "rejected").when(F.col("candidate_id").isNotNull(), "known").otherwise("admitted")
    out = chosen.join(known, "id", "left").withColumn("action", action)
    return out.select("id", F.when(F.col("action") == "known", F.col("candidate_id")).alias("candidate_id"), "action")


def transitions(events: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """How often each state is followed by which; the last of a key by null."""
    after = F.lead(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("next", after).groupBy(state, "next").agg(F.count(F.lit(1)).alias("count"))


def failure_breaks(events: DataFrame, order: list[str], key: str, failed: Column, most: int) -> DataFrame:
    """Runs of consecutive failures of a key that are `most` long or longer: key, run, length, first and last of order[0]."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_bad", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_bad")).over(w))
    runs = marked.where("_bad = 1").groupBy(key, F.col("_run").alias("run")).agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))
    return runs.where(F.col("length") >= most)
