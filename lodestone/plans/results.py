"""The rules that a result has to keep, as a table of what it breaks.

A result: result_id, task_id, role, disposition, summary, operation, invariant, facts, assumptions, counterevidence, unresolved, flow, follow_ups, of the types below. Rules about its own fields are predicates on the row; those
about what it cites are joins: with the spans served, the files' digests, its task's subject, and anchors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = "struct<file:string,start:bigint,end:bigint,sourceHash:string>"
CITED = f"array<struct<text:string,citations:array<{CITATION}>>>"
FLOW = f"array<struct<from:{CITATION},to:{CITATION},boundary:string,relationship:string,status:string>>"
PROPOSALS = f"array<struct<subjectId:string,theme:string,operation:{CITATION},rationale:string>>"
RESULT = (
    f"result_id string, task_id string, role string, disposition string, summary string, operation {CITATION}, invariant string, facts {CITED}, assumptions array<string>, counterevidence {CITED}, unresolved array<string>, "
    f"flow {FLOW}, follow_ups {PROPOSALS}"
)
# What fields may hold.
DISPOSITIONS = ("supported_candidate", "refuted_hypothesis", "no_relevant_operation", "needs_context", "budget_exhausted")
BOUNDARIES, STATUSES = ("local", "call", "persistence", "template", "configuration", "external"), ("candidate", "supported")
SUMMARY, TEXT, REMARK, FACTS, REMARKS, CITATIONS, FOLLOW_UPS = 8000, 4000, 2000, 30, 20, 10, 5
WITHOUT_OPERATION = ("no_relevant_operation", "budget_exhausted")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def no_more(items: Column, n: int) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= n


def own_problems() -> Column:
    """array<string> of a result's own fields."""
    empty = lambda c: F.coalesce(F.col(c), F.array())
    cited = lambda c, n: no_more(F.col(c), n) & F.forall(empty(c), lambda x: (F.length(x["text"]) <= TEXT) & F.size(x["citations"]).between(1, CITATIONS))
    remarks = lambda c: no_more(F.col(c), REMARKS) & F.forall(empty(c), lambda x: F.length(x) <= REMARK)
    flow = no_more(F.col("flow"), REMARKS) & F.forall(empty("flow"), lambda x: x["boundary"].isin(*BOUNDARIES) & x["status"].isin(*STATUSES) & F.length(x["relationship"]).between(1, REMARK))
    follow = no_more(F.col("follow_ups"), FOLLOW_UPS) & F.forall(empty("follow_ups"), lambda x: F.length(x["rationale"]).between(1, REMARK) & x["theme"].rlike("^[a-z-]{1,100}$") & x["operation"].isNotNull())
    whole = F.col("disposition").isin(*DISPOSITIONS) & F.length("summary").between(1, SUMMARY) & (F.length("invariant") <= TEXT) & cited("facts", FACTS) & cited("counterevidence", REMARKS) & remarks("assumptions") & remarks("unresolved") & flow & follow
    has_operation = F.col("operation").isNotNull()
    supported = has_operation & (F.size(empty("facts")) > 0) & (F.trim(F.coalesce("invariant", F.lit(""))) != "")
    checks = [
        ("invalid_result", whole),
        ("unsupported_candidate", (F.col("disposition") != "supported_candidate") | supported),
        ("operation_required", (F.col("role") != "localizer") | F.col("disposition").isin(*WITHOUT_OPERATION) | has_operation),
    ]
    return F.array_compact(F.array(*[F.when(~holds(ok), F.lit(name)) for name, ok in checks]))


def citations(results: DataFrame) -> DataFrame:
    """result_id, task_id and the spans of all that a result cites."""
    of = lambda c: F.flatten(F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.coalesce(x["citations"], F.array())))
    ends = F.flatten(F.transform(F.coalesce(F.col("flow"), F.array()), lambda x: F.array(x["from"], x["to"])))
    proposed = F.transform(F.coalesce(F.col("follow_ups"), F.array()), lambda x: x["operation"])
    every = F.array_compact(F.concat(of("facts"), of("counterevidence"), ends, proposed, F.array("operation")))
    return results.select("result_id", "task_id", F.explode(F.array_distinct(every)).alias("c")).select("result_id", "task_id", "c.*")


def problems(results: DataFrame, served: DataFrame, files: DataFrame, task_subjects: DataFrame, subjects: DataFrame, anchors: DataFrame, themes: Sequence[str]) -> DataFrame:
    """result_id, problem: each rule that a result breaks, once; a result without rows is accepted.

    served: task_id, file, start, end, sourceHash; files: file, hash, length; task_subjects: task_id, file, start, end of a task's subject; subjects: subject_id, file, start, end;
    anchors: file, start, end of parsed nodes and calls, which stand for syntax nodes, too.
    """
    own = results.select("result_id", F.explode(own_problems()).alias("problem"))
    cited = citations(results)
    s = served.select(*[F.col(c).alias(f"s_{c}") for c in ("task_id", "file", "start", "end", "sourceHash")])
    same = (F.col("task_id") == F.col("s_task_id")) & (F.col("file") == F.col("s_file")) & (F.col("sourceHash") == F.col("s_sourceHash"))
    unseen = cited.join(s, same & (F.col("s_start") <= F.col("start")) & (F.col("s_end") >= F.col("end")) & (F.col("end") > F.col("start")), "left_anti")
    f = files.select(F.col("file").alias("f_file"), "hash", "length")
    changed = cited.join(f, (F.col("file") == F.col("f_file")) & (F.col("sourceHash") == F.col("hash")) & (F.col("end") <= F.col("length")), "left_anti")
    a = anchors.select(F.col("file").alias("a_file"), F.col("start").alias("a_start"), F.col("end").alias("a_end")).distinct().withColumn("anchored", F.lit(True))
    at_anchor = (F.col("file") == F.col("a_file")) & (F.col("start") == F.col("a_start")) & (F.col("end") == F.col("a_end"))

    def placed(spans: DataFrame, owners: DataFrame, key: str) -> DataFrame:
        """spans with inside, whether their owner holds them, and known, whether they are an anchor or the owner itself."""
        o = owners.select(F.col(key).alias("o_key"), F.col("file").alias("o_file"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
        out = spans.join(o, F.col(key) == F.col("o_key"), "left").join(a, at_anchor, "left")
        inside = (F.col("file") == F.col("o_file")) & (F.col("start") >= F.col("o_start")) & (F.col("end") <= F.col("o_end"))
        whole = (F.col("start") == F.col("o_start")) & (F.col("end") == F.col("o_end"))
        return out.select("result_id", holds(inside).alias("inside"), (holds(F.col("anchored")) | holds(whole)).alias("known"))

    operations = placed(results.where("operation is not null").select("result_id", "task_id", "operation.*"), task_subjects, "task_id")
    proposals = results.select("result_id", F.explode("follow_ups").alias("p")).select("result_id", F.col("p.subjectId").alias("subject_id"), F.col("p.theme").alias("theme"), "p.operation.*")
    follow = placed(proposals, subjects, "subject_id")
    broken = [
        ("citation_not_observed", unseen), ("citation_hash_mismatch", changed), ("unknown_review_theme", proposals.where(~F.col("theme").isin(*themes))), ("followup_outside_subject", follow.where("not inside")),
        ("followup_not_parsed_anchor", follow.where("inside and not known")), ("operation_outside_function", operations.where("not inside")), ("operation_not_parsed_anchor", operations.where("inside and not known")),
    ]
    for name, rows in broken:
        own = own.unionByName(rows.select("result_id", F.lit(name).alias("problem")))
    return own.distinct()
