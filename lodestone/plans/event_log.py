"""The task queue as the fold of its event log: each task's events in order make its state, its attempts and what became of every event.

Fencing is in the fold: a result, a failure or an expiry counts only while the task runs the attempt that it names; what comes later is stale and changes nothing. The fold's state has a fixed size but for
the attempts, of which a role has three at most, so a task's events are folded within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import INCONCLUSIVE, MOST_ATTEMPTS, TERMINAL, next_role

EVENT = "struct<sequence:bigint,kind:string,attempt:string,at:bigint,deadline:bigint,disposition:string,result:string,error:string>"
ATTEMPT = "struct<id:string,role:string,started:bigint,finished:bigint,state:string,result:string>"
OUTCOME = "struct<sequence:bigint,accepted:boolean>"
STATE = f"struct<state:string,role:string,attempt:string,deadline:bigint,result:string,error:string,disposition:string,attempts:array<{ATTEMPT}>,outcomes:array<{OUTCOME}>>"
COLUMNS = ("sequence", "kind", "attempt", "at", "deadline", "disposition", "result", "error")


def step(s: Column, e: Column) -> Column:
    """The state after an event: claimed, result, failed, expired (a deadline has passed at `at`), retried or continued."""
    running, kind = s["state"] == "running", e["kind"]
    own = running & (s["attempt"] == e["attempt"])
    used = F.size(F.filter(s["attempts"], lambda a: a["role"] == s["role"]))
    back = F.when(s["role"] == "challenger", "investigator").otherwise(s["role"])
    used_back = F.size(F.filter(s["attempts"], lambda a: a["role"] == back))
    claimed = (kind == "claimed") & (s["state"] == "queued")
    result = (kind == "result") & own
    failed = (kind == "failed") & own
    expired = (kind == "expired") & own & (s["deadline"] < e["at"])
    retried = (kind == "retried") & (s["state"] == "failed") & (used < MOST_ATTEMPTS)
    continued = (kind == "continued") & (s["state"] == "completed") & s["disposition"].isin(*INCONCLUSIVE) & (used_back < MOST_ATTEMPTS)
    yes = lambda c: F.coalesce(c, F.lit(False))
    claimed, result, failed, expired, retried, continued = map(yes, (claimed, result, failed, expired, retried, continued))
    ends = (s["role"] == "challenger") | e["disposition"].isin(*TERMINAL)
    null = F.lit(None)
    state = F.when(claimed, "running").when(result, F.when(ends, "completed").otherwise("queued")).when(failed, "failed").when(expired | retried | continued, "queued").otherwise(s["state"])
    role = F.when(result & ~ends, next_role(s["role"])).when(continued, back).otherwise(s["role"])
    attempt = F.when(claimed, e["attempt"]).when(expired | retried | continued, null).otherwise(s["attempt"])
    deadline = F.when(claimed, e["deadline"]).when(result | failed | expired, null).otherwise(s["deadline"])
    error = F.when(result | retried | continued, null).when(failed, e["error"]).when(expired, "expired_attempt").otherwise(s["error"])
    closing = result | failed | expired
    how = F.when(result, "completed").when(failed, "failed").otherwise("expired")
    closed = F.transform(s["attempts"], lambda a: F.when(closing & (a["id"] == s["attempt"]) & (a["state"] == "running"), record(a["id"], a["role"], a["started"], e["at"], how, F.when(result, e["result"]))).otherwise(a))
    attempts = F.when(claimed, F.array_append(s["attempts"], record(e["attempt"], s["role"], e["at"], null, F.lit("running"), null))).otherwise(closed)
    accepted = claimed | result | failed | expired | retried | continued
    outcomes = F.array_append(s["outcomes"], F.struct(e["sequence"].alias("sequence"), accepted.alias("accepted")).cast(OUTCOME))
    new = (state, role, attempt, deadline, F.when(result, e["result"]).otherwise(s["result"]), error, F.when(result, e["disposition"]).otherwise(s["disposition"]), attempts, outcomes)
    return F.struct(*new).cast(STATE)


def record(*values: Column) -> Column:
    return F.struct(*values).cast(ATTEMPT)


def fold(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """tasks (id, and whatever else, but for the state's columns) with state, role, attempt, deadline, result, error, attempts, outcomes after all their events (task_id, sequence, kind, attempt, at,
    deadline, disposition, result, error), in order of sequence. A task without events is queued for the localizer; events of unknown tasks are passed over."""
    logs = events.select(F.col("task_id").alias("_task"), F.struct(*[F.col(c) for c in COLUMNS]).cast(EVENT).alias("e")).groupBy("_task").agg(F.array_sort(F.collect_list("e")).alias("_log"))
    first = F.struct(F.lit("queued"), F.lit("localizer"), *[F.lit(None)] * 5, F.array(), F.array()).cast(STATE)
    joined = tasks.join(logs, F.col("id") == F.col("_task"), "left").withColumn("_log", F.coalesce("_log", F.array().cast(f"array<{EVENT}>")))
    folded = joined.withColumn("_s", F.aggregate("_log", first, step))
    return folded.drop("_task", "_log").select(*tasks.columns, *[F.col(f"_s.{c}").alias(c) for c in ("state", "role", "attempt", "deadline", "result", "error", "attempts", "outcomes")])


def attempts(folded: DataFrame) -> DataFrame:
    """id, task_id, role, started, finished, state, result of every attempt."""
    return folded.select(F.col("id").alias("task_id"), F.explode("attempts").alias("a")).select("a.id", "task_id", "a.role", "a.started", "a.finished", "a.state", "a.result")


def stale(folded: DataFrame) -> DataFrame:
    """task_id, sequence of the events that changed nothing."""
    return folded.select(F.col("id").alias("task_id"), F.explode("outcomes").alias("o")).where("not o.accepted").select("task_id", F.col("o.sequence").alias("sequence"))
