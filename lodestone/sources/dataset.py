"""Importing a scored dataset: what it says of itself is checked against what is there, then it becomes one generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import relations
from . import readers, sinks

#: The files a dataset has to describe, the most bytes of a snapshot, and what tells one run from another.
REQUIRED = ("inventory.json",)
SNAPSHOT_BYTES = 512 << 20
IDENTITY = ("root", "model", "questionsHash", "sanitizerVersion")


#: What a run says of itself; nothing else of its files is read.
RUN = "root string, model string, questionsHash string, sanitizerVersion string, mode string, status string"


def stored(spark: SparkSession, path: str, schema: str = RUN) -> dict[str, object] | None:
    """The one JSON object at a path, by a schema, or None where there is nothing."""
    try:
        row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row.asDict() if row else None


def claim_output(spark: SparkSession, path: str, run: Mapping[str, str]) -> None:
    """Makes a folder a run's own. One that belongs to a run of another root, model, rubric, sanitizer or mode is refused; so is one whose only
    trace of that run is its summary."""
    for name in ("run.json", "summary.json"):
        before = stored(spark, f"{path}/{name}")
        if before and (any(before.get(k) != run.get(k) for k in IDENTITY) or before.get("mode") not in (None, run.get("mode"))):
            raise ValueError("the output belongs to a different run; choose another folder")
    spark.createDataFrame([dict(run)], ", ".join(f"{k} string" for k in run)).coalesce(1).write.mode("overwrite").json(f"{path}/run.json")


def meta(table: DataFrame, key: str) -> str | None:
    """The value of a key in a table of key and value."""
    row = table.where(F.col("key") == key).select("value").first()
    return row[0] if row else None


def problem(rows: DataFrame, name: str, key: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("problem"), key.cast("string").alias("key"))


def violations(manifest: DataFrame, dataset: DataFrame, source: DataFrame, inventory: DataFrame, functions: DataFrame, answers: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """problem, key: everything that doesn't fit. manifest: path, sha256, bytes of the dataset's files; dataset and source: files(); inventory: file, sourceHash;
    functions: id, file; answers: function_id. Nothing fits better by being left out: joins are anti or outer."""
    spark = manifest.sparkSession
    need = spark.createDataFrame([(x,) for x in required], "path string").join(manifest, "path", "left_anti")
    digest = lambda df: df.select("path", F.sha2("content", 256).alias("hash"), F.col("bytes").alias("size"))
    described = manifest.join(digest(dataset), "path", "left").where("hash is null or hash != sha256 or size != bytes")
    changed = inventory.join(digest(source).withColumnRenamed("path", "file"), "file", "left").where("hash is null or hash != sourceHash")
    private = inventory.where(F.col("file").rlike(paths.PRIVATE))
    unlisted = relations.unmatched(functions, inventory, "file", "file")
    unanswered, unknown = relations.unmatched(functions, answers, "id", "function_id"), relations.unmatched(answers, functions, "function_id", "id").select("function_id").distinct()
    twice = functions.groupBy("id").count().where("count > 1")
    found = [("missing_artifact_descriptor", need, "path"), ("dataset_hash_mismatch", described, "path"), ("source_hash_mismatch", changed, "file"), ("private_file_in_inventory", private, "file")]
    found += [("function_outside_inventory", unlisted, "id"), ("function_without_answers", unanswered, "id"), ("answers_without_function", unknown, "function_id"), ("repeated_function", twice, "id")]
    out = None
    for name, rows, key in found:
        part = problem(rows, name, F.col(key))
        out = part if out is None else out.unionByName(part)
    return out


def import_dataset(root: str, number: int, manifest: DataFrame, dataset: DataFrame, source: DataFrame, inventory: DataFrame, functions: DataFrame, answers: DataFrame, limit: int = SNAPSHOT_BYTES) -> str:
    """Checks a dataset and writes it as one generation below root: files, functions, answers, then meta, whose presence makes it complete. Returns imported, or
    already_imported where the same dataset is there; another one, a violation or a snapshot beyond the limit raises, and leaves no meta."""
    spark = manifest.sparkSession
    identity = relations.ordered_digest(manifest, ["path"], ["path", "sha256", "bytes"]).first()[0]
    try:
        before = meta(readers.generation(spark, root, "meta", number), "datasetId")
    except AnalysisException:
        before = None
    if before:
        if before != identity:
            raise ValueError("different_dataset")
        return "already_imported"
    if wrong := violations(manifest, dataset, source, inventory, functions, answers).first():
        raise ValueError(f"{wrong.problem}: {wrong.key}")
    snapshot = readers.snapshot(source).where("reason is null")
    if (snapshot.agg(F.sum("bytes")).first()[0] or 0) > limit:
        raise ValueError("snapshot_total_size_limit")
    for name, table in (("files", snapshot), ("functions", functions), ("answers", answers)):
        table.write.mode("overwrite").parquet(f"{root}/{name}/generation={number}")
    sinks.write_generation(spark.createDataFrame([("datasetId", identity)], "key string, value string"), root, "meta", number)
    return "imported"
