"""Transitions of the queue that take effect one after the other, whoever makes them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.generations import Conflict, Generations, Published
from . import lifecycle

Tables = Mapping[str, DataFrame]


def transition(store: Generations, change: Callable[[Tables], Tables], tries: int = 5) -> Published:
    """The generation that change makes of the latest one's tables; tables that it doesn't return are carried over. Where another coordinator publishes meanwhile, change is asked again, of what that one
    has published: so of two changes that both claim a task, one sees the other's claim. Conflict after `tries` times."""
    for left in reversed(range(tries)):
        with store.pinned() as seen:
            tables = {name: store.table(seen, name) for name in seen.tables}
            try:
                return store.publish({**tables, **change(tables)}, seen, seen.details)
            except Conflict:
                if not left:
                    raise
    raise ValueError("a transition is tried once at least")


def claim(store: Generations, n: int, now: int, timeout_ms: int, most_calls: int | None = None, tries: int = 5) -> Published:
    """Claims the next n tasks, none beyond the budget of calls: as many attempts as there are so far count as calls. Each claim is a row of attempts (id, task_id, role, started) and of events (task_id,
    sequence, kind, attempt, at, deadline)."""

    def change(tables: Tables) -> Tables:
        tasks, attempts, events = tables["tasks"], tables["attempts"], tables["events"]
        calls = attempts.count() if most_calls is not None else 0
        after = lifecycle.claim(tasks, n, now, timeout_ms, calls, most_calls)
        fresh = after.where("state = 'running'").join(tasks.where("state = 'queued'").select("id"), "id", "left_semi")
        started = fresh.select(F.col("attempt").alias("id"), F.col("id").alias("task_id"), "role", F.lit(now).cast("long").alias("started"))
        first = (events.agg(F.max("sequence")).first()[0] or 0) + 1
        at = F.row_number().over(Window.orderBy("id")) - 1 + first  # of n claims
        said = fresh.select(F.col("id").alias("task_id"), at.cast("long").alias("sequence"), F.lit("claimed").alias("kind"), "attempt", F.lit(now).cast("long").alias("at"), "deadline")
        return {"tasks": after, "attempts": attempts.unionByName(started), "events": events.unionByName(said)}

    return transition(store, change, tries)

