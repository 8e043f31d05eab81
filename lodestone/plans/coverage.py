"""Coverage and recall reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import INCONCLUSIVE


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def operation_groups(results: DataFrame, key: str) -> DataFrame:
    """One row: distinct_operations, supporting_records, repeated_groups. Null keys aren't groups."""
    groups = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    return groups.agg(
        F.count(F.lit(1)).alias("distinct_operations"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("supporting_records"),
        F.coalesce(F.sum((F.col("records") > 1).cast("long")), F.lit(0)).alias("repeated_groups"),
    )


def usage_totals(usage: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """One row; sums over no value are null."""
    return usage.agg(
        F.count(F.lit(1)).alias("observed_requests"),
        F.sum(input_col).alias("reported_input"),
        F.sum(output_col).alias("reported_output"),
        F.coalesce(F.sum((F.col(input_col).isNull() | F.col(output_col).isNull()).cast("long")), F.lit(0)).alias("incomplete_events"),
    )


def coverage_summary(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Reports by name, of those tables that are given: tasks, candidates, task_results, followups, subjects, coverage, files, omissions, usage."""
    out: dict[str, DataFrame] = {}
    t = tables.get
    if tasks := t("tasks"):
        out["tasks"] = counts(tasks, "state")
        out["execution"] = tasks.agg(F.coalesce(F.sum((F.col("state") != "completed").cast("long")), F.lit(0)).alias("outstanding"), F.count(F.lit(1)).alias("tasks")).withColumn("queue_drained", (F.col("tasks") > 0) & (F.col("outstanding") == 0))
    if candidates := t("candidates"):
        out["catalogue"], out["candidates_by_theme"] = counts(candidates, "decision"), counts(candidates, "theme", "decision")
    if (results := t("task_results")) and tasks:
        done = results.join(tasks.where("state = 'completed'").select(F.col("id").alias("task_id")), "task_id")
        out["dispositions"], out["operation_groups"] = counts(done, "disposition"), operation_groups(done, "operation_key")
        uncertain = done.agg(F.count_if(F.col("disposition").isin(*INCONCLUSIVE)).alias("n"))
        out["execution"] = out["execution"].withColumn("unresolved_completed", uncertain.select("n").scalar())
    if followups := t("followups"):
        out["followups"] = counts(followups, "state")
    if subjects := t("subjects"):
        out["subjects_by_purpose"] = counts(subjects, "purpose", "kind")
    if coverage := t("coverage"):
        out["capabilities"] = counts(coverage, "capability", "reasons")
    if (files := t("files")) and subjects:
        out["files_without_subjects"] = counts(files.join(subjects.select(F.col("file").alias("path")).distinct(), "path", "left_anti"), "language")
    if omissions := t("omissions"):
        out["omitted_files"] = counts(omissions, "reason")
    if usage := t("usage"):
        out["usage"] = usage_totals(usage, "input_tokens", "output_tokens")
    return out


def case_status(n: Column, selected: Column, completed: Column, outcomes: Column, supported: Column, refuted: Column, failed: Column, unsupported: Column, all_excluded: Column, negative: Column) -> Column:
    """A benchmark case's status from its candidates: counts n to outcomes, flags after."""
    unselected = F.when(unsupported, "unsupported_evidence").when(all_excluded, "excluded_by_scope").otherwise("unselected")
    reviewed = F.when(outcomes == 0, "different_operation_reviewed").when(supported, F.when(negative, "potential_false_positive").otherwise("supported")).when(refuted, "refuted").otherwise("unresolved")
    return F.when(n == 0, "no_candidate").when(selected == 0, unselected).when(completed == 0, F.when(failed, "failed").otherwise("pending")).otherwise(reviewed)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def recall(cases: DataFrame) -> DataFrame:
    """One row from cases (expected, selected, investigated, supported: booleans): counts and recalls; null where there is nothing to divide by, and
    the recall of detection only once something has been investigated."""
    positive = F.col("expected") == "positive"
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = cases.agg(
        n(positive).alias("applicable_positive"), n(positive & F.col("selected")).alias("selected_positive"), n(positive & F.col("investigated")).alias("investigated_positive"),
        n(positive & F.col("supported")).alias("supported_positive"), n((F.col("expected") == "negative") & F.col("supported")).alias("false_positive_flags"),
    )
    return (
        out.withColumn("selection_recall", ratio(F.col("selected_positive"), F.col("applicable_positive")))
        .withColumn("detection_recall", F.when(F.col("investigated_positive") > 0, F.col("supported_positive") / F.col("applicable_positive")))
        .withColumn("conditional_detection_recall", ratio(F.col("supported_positive"), F.col("investigated_positive")))
    )


def by_kind(subjects: DataFrame, contexts: DataFrame) -> DataFrame:
    """kind, count of the subjects in files (file) that have a context."""
    return counts(subjects.join(contexts.select("file").distinct(), "file", "left_semi"), "kind")


def distinct_per(rows: DataFrame, by: str, column: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count_distinct(column).alias("distinct_count"))


def evaluate_cases(cases: DataFrame, candidates: DataFrame, subjects: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, expected, candidates, status, selected, investigated, supported of every case (case_id, expected, file, start, end, themes). A case's candidates are those of its
    themes whose subject (subject_id, file, start, end) touches its line; candidates: id, subject_id, theme, decision; tasks: id, state; results: task_id, disposition, and the
    span they are about (op_file, op_start, op_end; null if none), which has to touch the line, too. What it gives goes into recall()."""
    t = tasks.select("id", F.col("state").alias("task_state"))
    c = candidates.join(subjects, "subject_id").join(t, "id", "left").join(results.withColumnRenamed("task_id", "id"), "id", "left").withColumnRenamed("file", "s_file")
    c = c.withColumnRenamed("start", "s_start").withColumnRenamed("end", "s_end")
    on = (F.col("file") == F.col("s_file")) & (F.col("s_start") <= F.col("end")) & (F.col("s_end") > F.col("start")) & F.array_contains("themes", F.col("theme"))
    own = cases.join(c, on, "left")
    done = (F.col("task_state") == "completed") & F.col("disposition").isNotNull()
    about = F.col("op_file").isNull() | ((F.col("op_file") == F.col("file")) & (F.col("op_start") <= F.col("end")) & (F.col("op_end") > F.col("start")))
    n = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0))
    a = own.groupBy("case_id", "expected").agg(
        F.count("id").alias("candidates"), n(F.col("task_state").isNotNull()).alias("chosen"), n(done).alias("done"), n(done & about).alias("outcomes"),
        n(done & about & (F.col("disposition") == "supported_candidate")).alias("yes"), n(done & about & F.col("disposition").isin("refuted_hypothesis", "no_relevant_operation")).alias("no"),
        n(F.col("task_state") == "failed").alias("failed"), n(F.col("decision") == "unsupported").alias("unsupported"), n(F.col("decision") == "excluded").alias("excluded"),
    )
    status = case_status(*map(F.col, ("candidates", "chosen", "done", "outcomes")), F.col("yes") > 0, F.col("no") > 0, F.col("failed") > 0, F.col("unsupported") > 0, F.col("excluded") == F.col("candidates"), F.col("expected") == "negative")
    return a.select("case_id", "expected", "candidates", status.alias("status"), (F.col("chosen") > 0).alias("selected"), (F.col("outcomes") > 0).alias("investigated"), (F.col("yes") > 0).alias("supported"))


def contract(tasks: DataFrame, texts: DataFrame, default: str) -> DataFrame:
    """tasks with the contract text of their theme, from a table (theme, text) of a row a theme, or the default."""
    return tasks.join(texts.select("theme", F.col("text").alias("contract")), "theme", "left").withColumn("contract", F.coalesce("contract", F.lit(default)))
