"""The review planner: rules make candidates of subjects, candidates get priorities, are spread over files and themes, and are selected.

Every step is a DataFrame; nothing is updated in place. Ranks inside a file or a theme are windows; the sample is a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators.relations import grouped_rank, largest_group, row_parts
from ..session import cut

# Fixed values: (theme, any of these questions, and any of these if there are some).
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("outbound-destination", ("operation_outbound_communication",), ()),
    ("query-structure", ("operation_database_query",), ()),
    ("file-target", ("operation_file_or_object_access",), ()),
    ("rendering-context", ("operation_content_rendering", "operation_template_processing"), ()),
    ("credential-output", ("output_sensitive_logging", "output_sensitive_uri", "output_sensitive_external_send"), ()),
    ("credential-return", ("output_sensitive_return", "output_sensitive_response"), ()),
    ("authority-binding", ("operation_authorization_decision",), ()),
    ("object-ownership", ("operation_data_store_access", "operation_database_query", "operation_file_or_object_access"), ("input_caller_supplied", "input_external_request_event_or_user", "influence_target_selection")),
    ("authentication-recovery", ("operation_identity_verification", "operation_credential_handling"), ()),
    ("cryptography", ("operation_cryptography",), ()),
    ("security-values", ("operation_security_value_generation",), ()),
    ("redirect-policy", ("operation_navigation_or_redirect",), ()),
    ("parsing-validation", ("operation_data_parsing",), ()),
    ("archive-policy", ("operation_archive_or_compression",), ()),
    ("resource-limits", ("operation_input_scaled_work",), ()),
    ("shared-state-invariant", ("operation_shared_state_check_and_act",), ()),
    ("external-execution", ("operation_external_program_execution", "operation_dynamic_code_interpretation"), ()),
    ("sensitive-storage", ("output_sensitive_storage",), ()),
    ("business-policy", ("context_intended_policy", "influence_security_settings", "influence_identity_or_authority"), ()),
    ("response-disclosure", ("output_sensitive_response",), ()),
)
GENERAL, CONTROL = "general-review", "control-sample"
# What the kinds of subjects that aren't functions are reviewed for, and their first priorities.
KIND_THEMES = {"template": ("rendering-context",), "dependency_manifest": ("dependency-security",), "configuration": ("configuration-policy",)}
KIND_THEMES |= {k: ("endpoint-policy", "object-ownership", "response-disclosure") for k in ("route_declaration", "generated_crud")}
KIND_PRIORITY, KIND_PRIORITY_DEFAULT = {"route_declaration": 15, "template": 80}, 120
#: All themes that a candidate may have.
THEMES = tuple(dict.fromkeys([*(r[0] for r in RULES), GENERAL, CONTROL, *(t for names in KIND_THEMES.values() for t in names)]))
NOT_APPLICATION = ("test_or_fixture", "example_or_tooling", "vendor")
FILE_STEP, THEME_STEP, BOOST, CONTROL_PRIORITY = 20, 4, 20, 150


def array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def signals(answers: DataFrame, id_col: str = "subject_id") -> DataFrame:
    """id and the questions answered present or unclear."""
    return answers.groupBy(id_col).agg(F.collect_set(F.when(F.col("choice").isin("present", "unclear"), F.col("question"))).alias("signals"))


def themes(found: Column, rules=RULES) -> Column:
    """The themes whose rules hold for an array of signals, in the rules' order; the general one where none does."""
    hits = [F.when(F.arrays_overlap(found, array(any_)) & (F.arrays_overlap(found, array(context)) if context else F.lit(True)), F.lit(name)) for name, any_, context in rules]
    listed = F.array_compact(F.array(*hits))
    return F.when(F.size(listed) > 0, listed).otherwise(array([GENERAL]))


def base_priority(found: Column, purpose: Column) -> Column:
    """Lower is sooner."""
    less = [("input_external_request_event_or_user", 35), ("influence_interpreted_structure", 20), ("influence_target_selection", 10)]
    out = F.lit(100)
    for question, n in less:
        out = out - F.when(F.array_contains(found, question), n).otherwise(0)
    return F.greatest(F.lit(0), out + F.when(purpose == "initialization", 25).otherwise(0)).cast("long")


def candidates(subjects: DataFrame, answers: DataFrame, seed: str, rules=RULES, all_source: bool = False) -> DataFrame:
    """id, subject_id, file, theme, purpose, priority, rank, decision for every subject (subject_id, file, kind, purpose) and theme of its."""
    s = subjects.join(signals(answers), "subject_id", "left").withColumn("signals", F.coalesce("signals", array([])))
    own = themes(F.col("signals"), rules)
    priority = base_priority(F.col("signals"), F.col("purpose"))
    other, first = array([GENERAL]), F.lit(KIND_PRIORITY_DEFAULT)
    for kind, names in KIND_THEMES.items():
        other = F.when(F.col("kind") == kind, array(names)).otherwise(other)
    for kind, n in KIND_PRIORITY.items():
        first = F.when(F.col("kind") == kind, n).otherwise(first)
    is_function = F.col("kind").isin("function", "unclassified_function")
    out = s.select("subject_id", "file", "kind", "purpose", F.when(is_function, priority).otherwise(first).cast("long").alias("priority"), F.explode(F.when(is_function, own).otherwise(other)).alias("theme"))
    decision = F.when(~F.lit(all_source) & F.col("purpose").isin(*NOT_APPLICATION), "excluded").when(F.col("kind") == "unsupported_source", "unsupported").otherwise("deferred")
    key = [F.col("subject_id").cast("string"), F.col("theme")]
    return out.withColumn("id", canonical(*key)).withColumn("rank", F.sha2(F.concat(F.lit(seed), *key), 256)).withColumn("decision", decision)


def boost(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Functions in files that a declared route handles come sooner. targets: file."""
    marks = targets.select(F.col("file").alias("_f")).distinct()
    is_function = F.col("kind").isin("function", "unclassified_function")
    sooner = F.when(F.col("_f").isNotNull() & is_function, F.greatest(F.lit(0), F.col("priority") - BOOST)).otherwise(F.col("priority"))
    return rows.join(marks, F.col("file") == F.col("_f"), "left").withColumn("priority", sooner.cast("long")).drop("_f")


def declared_use(contexts: DataFrame, origins: DataFrame) -> DataFrame:
    """contexts (file, purpose) with original_purpose: a file left out by its path alone counts as the application's where one of origins' targets says that
    the application refers to it."""
    marks = origins.select(F.col("target").alias("_t")).distinct()
    used = F.col("_t").isNotNull() & F.col("purpose").isin(*NOT_APPLICATION)
    out = contexts.join(marks, F.col("file") == F.col("_t"), "left").withColumn("original_purpose", F.when(used, F.col("purpose")))
    return out.withColumn("purpose", F.when(used, "application_candidate").otherwise(F.col("purpose"))).drop("_t")


def with_purpose(functions: DataFrame, contexts: DataFrame) -> DataFrame:
    """functions (file) with the purpose of their file (file, purpose); the one that they have, or null, where it has none."""
    own = contexts.select(F.col("file").alias("_f"), F.col("purpose").alias("_purpose")).dropDuplicates(["_f"])
    out = functions.join(own, F.col("file") == F.col("_f"), "left")
    before = F.col("purpose") if "purpose" in functions.columns else F.lit(None).cast("string")
    return out.withColumn("purpose", F.coalesce("_purpose", before)).drop("_f", "_purpose")


def diversify(rows: DataFrame) -> DataFrame:
    """Deferred candidates, later by their place in their file and in their theme, of which one may hold most; others keep their priority. Candidates are worked out once."""
    known = cut(rows)
    order = [F.col("priority").asc(), F.col("rank").asc(), F.col("id").asc()]
    ranked = deferred = known.where("decision = 'deferred'")
    parts = row_parts(deferred.count(), rows.sparkSession)
    for by in ("file", "theme"):
        ranked = grouped_rank(ranked, [by], order, f"_{by}", largest=largest_group(deferred, [by]), parts=parts)
    later = F.col("priority") + (F.col("_file") - 1) * FILE_STEP + (F.col("_theme") - 1) * THEME_STEP
    moved = ranked.withColumn("priority", later.cast("long")).select(*rows.columns)
    return moved.unionByName(known.where("decision is null or decision != 'deferred'"))


def select_all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("decision", F.when(F.col("decision") == "deferred", "selected").otherwise(F.col("decision")))


def select_sample(rows: DataFrame, maximum: int) -> DataFrame:
    """rows with a reproducible sample of `maximum` selected: the first by priority, a fifth of controls (from 5 on), one a subject that
    has none selected, and more of the first if controls lack."""
    controls = maximum // 5 if maximum >= 5 else 0
    order = ["priority", "rank", "id"]
    deferred = rows.where("decision = 'deferred'")
    first = deferred.orderBy(*order).limit(maximum - controls).select("id")
    # subjects first, each a row, then those that have none selected
    subjects = deferred.select("subject_id", "rank", "purpose", "file", "kind").repartition(row_parts(deferred.count(), rows.sparkSession), "subject_id")
    least = subjects.groupBy("subject_id").agg(F.min("rank").alias("rank"), F.first("purpose").alias("purpose"), F.first("file").alias("file"), F.first("kind").alias("kind"))
    least = least.join(deferred.join(first, "id", "left_semi").select("subject_id").distinct(), "subject_id", "left_anti")
    least = least.join(rows.where("decision = 'selected'").select("subject_id").distinct(), "subject_id", "left_anti")
    control = least.orderBy("rank", "subject_id").limit(controls)
    control = control.withColumn("theme", F.lit(CONTROL)).withColumn("priority", F.lit(CONTROL_PRIORITY).cast("long")).withColumn("decision", F.lit("selected"))
    control = control.withColumn("id", canonical(F.col("subject_id").cast("string"), F.col("theme")))
    # what controls lack is taken from what is still deferred: so many rows after the first are read, and as many as are missing are kept
    lacking = F.lit(controls) - control.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() if controls else F.lit(0)
    more = deferred.join(first, "id", "left_anti").orderBy(*order).limit(controls).withColumn("_at", F.row_number().over(Window.orderBy(*order))).where(F.col("_at") <= lacking).select("id")
    chosen = first.unionByName(more).withColumn("_chosen", F.lit(True))
    marked = rows.join(chosen, "id", "left").withColumn("decision", F.when(F.col("_chosen"), "selected").otherwise(F.col("decision"))).drop("_chosen")
    return marked.unionByName(control.select(*marked.columns))


def tasks(planned: DataFrame) -> DataFrame:
    """The queue that a plan makes."""
    return planned.where("decision = 'selected'").select("id", "subject_id", "theme", "purpose", F.lit("queued").alias("state"), F.lit("localizer").alias("role"), "priority")


def plan(subjects: DataFrame, answers: DataFrame, routed: DataFrame, seed: str = "plan-1", maximum: int | None = None, rules=RULES, all_source: bool = False) -> DataFrame:
    """All candidates, planned: in full, or a sample of `maximum`."""
    if maximum is not None and maximum < 1:
        raise ValueError("a sample has one candidate at least")
    if not seed or len(seed) > 200:
        raise ValueError("a seed has 1 to 200 characters")
    rows = diversify(boost(candidates(subjects, answers, seed, rules, all_source), routed))
    return select_all(rows) if maximum is None else select_sample(cut(rows), maximum)  # which reads them several times
