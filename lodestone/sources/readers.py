"""Sources: files under a scan policy, JSON arrays and lines under a schema, stored generations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import paths
from ..operators.configuration import MOST_DEPTH, json_depth

#: The largest file and record, in bytes.
FILE_BYTES, RECORD_BYTES = 16 << 20, 32 << 20


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), bytes, content of every file below root; a file is one row, so `snapshot` bounds them. Names that begin with a dot or an underscore
    are hidden from Spark's readers and so never enter."""
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    whole = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return found.select(F.substring(whole, F.lit(len(base) + 2), F.length(whole)).alias("path"), F.col("length").alias("bytes"), "content")


def snapshot(found: DataFrame, largest: int = FILE_BYTES) -> DataFrame:
    """files() with reason (null for a file that is taken), public, language and purpose. Content of files left out is null."""
    path = F.col("path")
    known = path.rlike(paths.CONFIG) | path.rlike(paths.LANGUAGES[2][1]) | path.rlike(paths.CONTEXT) | path.rlike(r"(?i)\.(?:[cm]?[jt]sx?|cs)$") | path.rlike(paths.DOCUMENT)
    reason = (
        F.when(path.rlike(paths.PRIVATE), "private_file_policy")
        .when(paths.in_excluded_directory(path), "generated_or_installed_directory")
        .when(~known, "unsupported_content_metadata_only")
        .when(F.col("bytes") > largest, "file_size_limit")
    )
    out = found.withColumn("reason", reason).withColumn("public", path.rlike(paths.PUBLIC))
    out = out.withColumn("public", F.col("public") & F.col("reason").isNull())
    return out.withColumn("content", F.when(F.col("reason").isNull(), F.col("content"))).withColumn("hash", F.sha2("content", 256)).withColumn("language", paths.language(path)).withColumn("purpose", paths.purpose(path))


def public_assets(found: DataFrame) -> DataFrame:
    """path, bytes, extension of the files that the application serves as they are, whether a snapshot takes them or not. Their content isn't read."""
    return found.where(F.col("path").rlike(paths.PUBLIC)).select("path", "bytes", paths.extension(F.col("path")).alias("extension"))


def changed_while_read(found: DataFrame) -> DataFrame:
    """path of the files whose content isn't as long as their listing says."""
    return found.where(F.octet_length("content") != F.col("bytes")).select("path")


def omissions(taken: DataFrame, listed: DataFrame) -> DataFrame:
    """path, reason of what a snapshot leaves out: what its policy says, and of the paths that are listed elsewhere (path, kind), such as hidden files and links that Spark's
    readers don't see, the rest: private ones by policy, links and hidden ones by kind."""
    path = F.col("path")
    unseen = listed.join(taken.select("path"), "path", "left_anti")
    reason = F.when(path.rlike(paths.PRIVATE), "private_file_policy").when(F.col("kind") == "link", "symbolic_link").otherwise("hidden_from_reader")
    return taken.where("reason is not null").select("path", "reason").unionByName(unseen.select("path", reason.alias("reason")))


def inventory(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source files, skipped ones with a reason) of files(), each in order of path."""
    path = F.col("path")
    reason = F.when(paths.in_excluded_directory(path), "excluded_directory").when(path.rlike(paths.DECLARATION), "declaration").when(~path.rlike(paths.SOURCE), "not_source")
    marked = found.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason").orderBy("path"), marked.where("reason is not null").select("path", "reason").orderBy("path")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Records of a file of JSON lines; blank lines don't count. strict: a broken record fails the query, else it is all null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def bounded_lines(spark: SparkSession, path: str, schema: str, most_bytes: int = RECORD_BYTES, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Records of a file of JSON lines, each looked at before it is parsed: one that is too long, nested too deeply or broken fails the query. Blank lines don't count."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    refused = F.when(F.octet_length("value") > most_bytes, F.raise_error(F.lit("record_size_limit"))).when(json_depth(F.col("value")) > most_depth, F.raise_error(F.lit("record_depth_limit")))
    checked = lines.select(F.coalesce(refused.cast("string"), F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str, schema: str, member: str | None = None) -> DataFrame:
    """Elements of a JSON array, or of the array in a member of an object. schema is that of an element, as DDL."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if member is None:
        return reader.schema(schema).json(path)
    return reader.schema(StructType([StructField(member, ArrayType(StructType.fromDDL(schema)))])).json(path).select(F.explode(member).alias("_e")).select("_e.*")


def too_large(records: DataFrame, column: str, most: int = RECORD_BYTES) -> DataFrame:
    return records.where(F.octet_length(column) > most)


def generation(spark: SparkSession, root: str, table: str, number: int) -> DataFrame:
    """A table of a stored generation; other generations' folders aren't listed."""
    return spark.read.parquet(f"{root}/{table}/generation={number}")


def sql(spark: SparkSession, query: str, **parameters) -> DataFrame:
    """A query with named parameters."""
    return spark.sql(query, args=parameters)
