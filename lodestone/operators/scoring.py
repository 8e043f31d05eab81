"""Answers in long form, ranking and classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import REVIEW_ORDER
from .relations import global_rank


def answers_long(wide: DataFrame, id_col: str, answers: str = "answers") -> DataFrame:
    """id, question and the answer's fields from a map question -> struct<choice, confidence, probabilities>."""
    return wide.select(F.col(id_col), F.explode(answers).alias("question", "answer")).select(id_col, "question", "answer.*")


def answers_wide(long: DataFrame, id_col: str) -> DataFrame:
    """id and a map question -> choice, in order of questions."""
    return long.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "choice")))).alias("choices"))


def precedence(choice: Column) -> Column:
    """A label's place in the order of review; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in REVIEW_ORDER]), choice), F.lit(0)), F.lit(len(REVIEW_ORDER) + 1))


def summarize(long: DataFrame, id_col: str) -> DataFrame:
    """A row an id: relevance, defect_evidence, context_needed (maxima over the answers, never sums), review_label, relevant_categories.

    long has question, choice and the probabilities p_na, p_defect, p_context."""
    return long.groupBy(id_col).agg(
        F.max(1 - F.col("p_na")).alias("relevance"),
        F.max("p_defect").alias("defect_evidence"),
        F.max("p_context").alias("context_needed"),
        F.min_by("choice", precedence(F.col("choice"))).alias("review_label"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("choice") != "not_applicable", F.col("question"))))).alias("relevant_categories"),
    )


def rank(summaries: DataFrame, id_col: str) -> DataFrame:
    """With relevance_rank and review_rank, by range-partitioned sorts. Ids are unique."""
    by_relevance = [F.desc("relevance"), F.asc(id_col)]
    by_review = [precedence(F.col("review_label")).asc(), F.desc("defect_evidence"), F.desc("context_needed"), F.desc("relevance"), F.asc(id_col)]
    return global_rank(global_rank(summaries, by_relevance, "relevance_rank"), by_review, "review_rank")


def classify(long: DataFrame, id_col: str, rubric: Sequence[str] = ()) -> DataFrame:
    """A row an id: the questions answered present and unclear, in the rubric's order, others after them by name, and the guard behaviour or null."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(q) for q in rubric]).cast("array<string>"), F.col("question")), F.lit(0)), F.lit(len(rubric) + 1))
    of = lambda label: F.array_sort(F.collect_list(F.when(F.col("choice") == label, F.struct(order.alias("at"), F.col("question").alias("q")))))
    listed = lambda label: F.concat_ws(",", F.transform(of(label), lambda x: x["q"]))
    return long.groupBy(id_col).agg(
        listed("present").alias("present_categories"),
        listed("unclear").alias("unclear_categories"),
        F.max(F.when(F.col("question") == "guard_failure_behavior", F.col("choice"))).alias("guard_failure_behavior"),
    )


def split_reusable(items: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """items with action: reuse where an evaluated record has their key, else retry where a failed one has, else queue."""
    known = records.groupBy(F.col(key).alias("_k")).agg(F.max((F.col("status") == "evaluated").cast("int")).alias("_ok"))
    action = F.when(F.col("_ok") == 1, "reuse").when(F.col("_ok") == 0, "retry").otherwise("queue")
    return items.join(known, F.col(key) == F.col("_k"), "left").withColumn("action", action).drop("_k", "_ok")


def run_status(counts: DataFrame, inventory_only: bool = False) -> DataFrame:
    """status from blocked, interrupted, failed and pending counts, the first that holds."""
    status = F.when(F.lit(inventory_only), "inventory_only").when(F.col("blocked") > 0, "blocked").when(F.col("interrupted") > 0, "interrupted")
    return counts.withColumn("status", status.when(F.col("failed") + F.col("pending") > 0, "partial").otherwise("complete"))


def run_counters(items: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """One row over the selected items (key) and their records (key, status, reused, input_tokens): selected, evaluated, reused, failed, pending, and
    new_input_tokens, those of evaluated records that weren't reused."""
    r = records.select(F.col(key).alias("_k"), "status", "reused", "input_tokens")
    joined = items.join(r, F.col(key) == F.col("_k"), "left")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    done = F.col("status") == "evaluated"
    return joined.agg(
        F.count(F.lit(1)).alias("selected"), n(done).alias("evaluated"), n(done & F.col("reused")).alias("reused"), n(F.col("status") == "failed").alias("failed"),
        n(F.col("_k").isNull()).alias("pending"), F.coalesce(F.sum(F.when(done & ~F.col("reused"), F.col("input_tokens"))), F.lit(0)).alias("new_input_tokens"),
    )


def inventory_counters(files: DataFrame, skipped: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: files, skipped, functions, files_with_parse_errors, from files and skipped ones (path) and functions (file, parseDiagnostics: an array)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    broken = functions.where(F.size("parseDiagnostics") > 0).agg(F.count_distinct("file").alias("files_with_parse_errors"))
    out = n(functions, "functions")
    for part, name in ((n(files, "files"), "files"), (n(skipped, "skipped"), "skipped"), (broken, "files_with_parse_errors")):
        out = out.withColumn(name, part.select(name).scalar())
    return out.select("files", "skipped", "functions", "files_with_parse_errors")


#: The columns that hold source texts.
SOURCES = ("function", "body", "sanitizedFunction")


def without_sources(rows: DataFrame) -> DataFrame:
    return rows.drop(*SOURCES)


def select_matching(items: DataFrame, column: str, part: str, order: str, limit: int | None = None) -> DataFrame:
    """The items whose column contains a text, the first `limit` of them in order."""
    found = items.where(F.contains(F.col(column), F.lit(part)))
    return found if limit is None else found.orderBy(order).limit(limit)


def failures_and_pending(items: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, problem: the error of items whose record failed, and pending for those without one."""
    r = records.select(F.col(key).alias("_k"), "status", "error")
    joined = items.select(key).join(r, F.col(key) == F.col("_k"), "left").where("_k is null or status = 'failed'")
    return joined.select(key, F.when(F.col("_k").isNull(), "pending").otherwise(F.coalesce("error", F.lit(""))).alias("problem"))
