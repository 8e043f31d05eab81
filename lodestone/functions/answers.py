"""Checks of answers and rubrics as column expressions, and keys of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical

# Labels, in order of review.
DEFECT_LABELS = ("not_applicable", "locally_protected", "local_defect", "context_required")
REVIEW_ORDER = ("local_defect", "context_required", "locally_protected", "not_applicable")
PRESENCE_LABELS = ("present", "absent", "unclear")
#: Each probability may be off by this much, from rounding; the chosen one by SLIGHT from the largest.
ROUNDING, EPSILON, SLIGHT = 0.005, 2.220446049250313e-16, 0.000001


def same_keys(m: Column, keys: Column) -> Column:
    """Whether a map has just these keys."""
    return F.array_sort(F.map_keys(m)) == F.array_sort(keys)


def is_probability(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & x.between(0.0, 1.0), F.lit(False))


def is_count(x: Column) -> Column:
    return F.coalesce((x >= 0) & (x <= (1 << 53) - 1) & (x == F.floor(x)), F.lit(False))


def violations(choice: Column, confidence: Column, probabilities: Column, labels: Column, slight: float = SLIGHT) -> Column:
    """array<string>: what is wrong with an answer, in a fixed order; empty if nothing is. Probabilities are a map label -> double;
    they may add up to 1 within their number times ROUNDING, and the choice's may not be below the largest."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    checks = [
        ("choice", F.array_contains(labels, choice)),
        ("confidence", is_probability(confidence)),
        ("labels", same_keys(probabilities, labels)),
        ("probability", F.forall(values, is_probability)),
        ("total", F.abs(total - 1) <= F.size(labels) * F.lit(ROUNDING) + F.lit(EPSILON)),
        ("maximum", F.element_at(probabilities, choice) + slight >= F.array_max(values)),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def response_violations(model: Column, wanted: Column, answers: Column, rubric: Column, usage: Column, slight: float = SLIGHT) -> Column:
    """array<string>: what is wrong with a whole response. answers: map question -> struct<type, choice, confidence, probabilities>, whose questions have to be the rubric's, each with an answer by its
    criteria's labels (named question:problem); the model has to be the one asked, token counts (usage: struct<input_tokens, output_tokens>) whole numbers from 0 on."""
    of = lambda e: F.transform(violations(e["value"]["choice"], e["value"]["confidence"], e["value"]["probabilities"], F.map_keys(F.element_at(rubric, e["key"])["criteria"]), slight), lambda x: F.concat(e["key"], F.lit(":"), x))
    each = F.flatten(F.transform(F.map_entries(answers), lambda e: F.when(F.map_contains_key(rubric, e["key"]), of(e)).otherwise(F.array().cast("array<string>"))))
    kind = F.transform(F.filter(F.map_entries(answers), lambda e: ~F.coalesce(e["value"]["type"] == "choice", F.lit(False))), lambda e: F.concat(e["key"], F.lit(":type")))
    checks = [("model", model == wanted), ("answers", same_keys(answers, F.map_keys(rubric))), ("usage", is_count(usage["input_tokens"]) & is_count(usage["output_tokens"]))]
    own = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))
    return F.concat(own, F.coalesce(F.concat(kind, each), F.array().cast("array<string>")))


def rubric_mode(rubric: Column) -> Column:
    """defects or classification for a rubric, map question -> struct<type, instructions, criteria: map>; null if it is neither."""
    entries = F.map_entries(rubric)
    whole = lambda e: (e["value"]["type"] == "choice") & (F.trim(e["value"]["instructions"]) != "")
    keys = lambda e, labels: same_keys(e["value"]["criteria"], F.array(*[F.lit(x) for x in labels]))
    defects = F.forall(entries, lambda e: whole(e) & keys(e, DEFECT_LABELS))
    presence = F.forall(entries, lambda e: whole(e) & e["key"].rlike("^(operation|input|influence|guard|output|context)_") & keys(e, PRESENCE_LABELS))
    return F.when(F.size(entries) < 1, None).when(defects, "defects").when(presence, "classification")


def request_key(source_hash: Column, id_: Column, text: Column, rubric: Column, model: Column, version: int = 2) -> Column:
    """The key of a request: anything that changes what is asked changes it."""
    return canonical(F.lit(version), source_hash, id_, text, rubric, model)
