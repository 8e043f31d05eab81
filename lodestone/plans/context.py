"""The context index of a snapshot: by each file's format its text without comments, its anchors, what of it is reviewed, and how much of it could be read."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators import configuration, elements, markup

# The formats, and what is said of files.
TEMPLATE, JSON, YAML = r"(?i)\.(?:html?|vue|svelte)$", r"(?i)\.jsonc?$", r"(?i)\.ya?ml$"
PARSED_ELSEWHERE = ("tsjs", "csharp")
INDEXED, PARTIAL, UNAVAILABLE = "indexed", "partial", "unavailable"
NO_SEMANTICS, NEEDS_PARSER, NOTHING = "format_semantics_unavailable", "needs_a_language_parser", "no_reviewable_declarations"


def file_format(path: Column, language: Column) -> Column:
    """template, json, yaml, code (which needs a language's parser) or text."""
    template = (language == "template") & path.rlike(TEMPLATE)
    return F.when(language.isin(*PARSED_ELSEWHERE), "code").when(template, "template").when(path.rlike(JSON), "json").when(path.rlike(YAML), "yaml").otherwise("text")


def index(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of files (path, unique; hash, language, text): texts (file, text, of the same length), anchors (file, start, end, kind, name), subjects (subject_id, file, start, end, kind) and
    context_files (file, hash, capability, reasons).

    Templates, JSON with comments and indented YAML are read; other configuration is a subject as a whole, of which only the text is known. Program code has its evidence from elsewhere, and is unavailable here. Null texts
    are unavailable, too; empty ones have no subject.
    """
    rows = files.withColumn("format", file_format(F.col("path"), F.col("language")))
    of = {name: rows.where((F.col("format") == name) & F.col("text").isNotNull()) for name in ("template", "json", "yaml", "text")}
    masked = F.when(F.col("format") == "template", markup.masked(F.col("text"))).when(F.col("format") == "json", configuration.json_masked(F.col("text"))).when(F.col("format") == "yaml", configuration.yaml_masked(F.col("text"))).otherwise(F.col("text"))
    texts = rows.where(F.col("text").isNotNull() & (F.col("format") != "code")).select(F.col("path").alias("file"), masked.alias("text"))

    nodes = elements.template_anchors(of["template"], "path", "text").select("path", "start", "end", "kind", "name")
    keys = configuration.json_properties(of["json"].withColumnRenamed("path", "file"), "file", "text").select(F.col("file").alias("path"), "start", "end", F.lit("configuration_property").alias("kind"), F.col("key").alias("name"))
    lines = configuration.yaml_nodes(of["yaml"], "path", "text").select("path", "start", "end", F.lit("configuration_node").alias("kind"), F.col("container").alias("name"))
    anchors = functools.reduce(DataFrame.unionByName, [nodes, keys, lines]).withColumnRenamed("path", "file")

    whole = F.when(F.col("format") == "template", "template").when((F.col("format") == "json") & F.col("path").rlike(configuration.MANIFEST), "dependency_manifest").when((F.col("format") == "text") & (F.col("language") == "template"), "template").otherwise("configuration")
    some = rows.where((F.length("text") > 0) & (F.col("format") != "code"))
    subjects = some.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), whole.alias("kind"), "hash")
    subjects = subjects.select(canonical(*[F.col(c) for c in ("file", "hash", "start", "end", "kind")]).alias("subject_id"), "file", "start", "end", "kind")

    told = configuration.json_reasons(of["json"], "path", "text").unionByName(configuration.yaml_reasons(of["yaml"], "path", "text"))
    told = told.groupBy("path").agg(F.array_sort(F.collect_set("reason")).alias("told"))
    reason = F.when(F.col("format") == "code", NEEDS_PARSER).when(F.col("text").isNull(), "unreadable").when(F.length("text") == 0, NOTHING).when(F.col("format") == "text", NO_SEMANTICS)
    reasons = F.array_compact(F.concat(F.coalesce("told", F.array().cast("array<string>")), F.array(reason)))
    found = rows.join(told, "path", "left").withColumn("reasons", reasons)
    capability = F.when(F.col("text").isNull() | (F.col("format") == "code"), UNAVAILABLE).when(F.size("reasons") > 0, PARTIAL).otherwise(INDEXED)
    return {"texts": texts, "anchors": anchors, "subjects": subjects, "context_files": found.select(F.col("path").alias("file"), "hash", capability.alias("capability"), "reasons")}
