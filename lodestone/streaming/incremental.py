"""An index that is built by batches of files, each committed once.

A batch's rows and its commits are folders named by generation and batch, written whole: rows first, then the commits, which name the files that are in. A batch that runs again
writes the same folders again, so nothing is there twice; a batch that failed half way has no commits, and its rows aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: What can become of a file.
REUSED, FROM_PREVIOUS, PARSED, UNAVAILABLE = "reused", "reused_from_previous", "parsed", "unavailable"
COMMITS = "file string, hash string, action string"


class Index:
    """Rows that parse() makes of files (file, hash, content; null where it couldn't be read), below root."""

    def __init__(self, root: str, generation: str, parse: Callable[[DataFrame], DataFrame], previous: str | None = None):
        if previous == generation:
            raise ValueError("the generation to reuse is another one")
        self.root, self.generation, self.parse, self.previous = root.rstrip("/"), generation, parse, previous

    def folder(self, table: str, generation: str, batch: int | None = None) -> str:
        return f"{self.root}/{table}/generation={generation}" + ("" if batch is None else f"/batch={batch}")

    def stored(self, spark: SparkSession, table: str, generation: str, schema: str | None = None) -> DataFrame | None:
        """A generation's table with its column batch, or none where nothing is stored."""
        try:
            reader = spark.read.schema(f"{schema}, batch long") if schema else spark.read
            return reader.parquet(self.folder(table, generation))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def commits(self, spark: SparkSession, generation: str | None = None) -> DataFrame:
        """file, hash, action, batch: what is in, of each file the first batch that has it."""
        found = self.stored(spark, "commits", generation or self.generation, COMMITS)
        return found if found is not None else spark.createDataFrame([], f"{COMMITS}, batch long")

    def rows(self, spark: SparkSession, generation: str | None = None) -> DataFrame | None:
        """The rows of committed files."""
        found = self.stored(spark, "rows", generation or self.generation)
        if found is None:
            return None
        own = self.commits(spark, generation).where(F.col("action").isin(PARSED, FROM_PREVIOUS)).select("file", "batch")
        return found.join(own, ["file", "batch"], "left_semi").drop("batch")

    def process(self, batch: DataFrame, number: int) -> None:
        """Indexes a batch of files (file, hash, content); for foreachBatch. Of a file that is in a batch twice, one row counts.

        A file that another batch of this generation has under the same hash is reused; one that the previous generation has, not unavailable, is copied with its rows; the rest is parsed, or
        unavailable where its content is null.
        """
        spark = batch.sparkSession
        one = F.row_number().over(Window.partitionBy("file").orderBy(F.col("hash").asc_nulls_last()))
        files = batch.select("file", "hash", "content").withColumn("_n", one).where("_n = 1").drop("_n")
        here = self.commits(spark).where(F.col("batch") != number).where(F.col("action") != UNAVAILABLE).select("file", "hash").distinct().withColumn("_here", F.lit(True))
        files = files.join(here, ["file", "hash"], "left")
        before = self.commits(spark, self.previous) if self.previous else here.limit(0).withColumn("action", F.lit(""))
        before = before.where(F.col("action") != UNAVAILABLE).select("file", "hash").distinct().withColumn("_before", F.lit(True))
        files = files.join(before, ["file", "hash"], "left")
        action = F.when(F.col("_here"), REUSED).when(F.col("_before"), FROM_PREVIOUS).when(F.col("content").isNull(), UNAVAILABLE).otherwise(PARSED)
        files = cut(files.withColumn("action", action).drop("_here", "_before"))
        made = self.parse(files.where(F.col("action") == PARSED).drop("action"))
        old = self.rows(spark, self.previous) if self.previous else None
        if old is not None:
            copied = old.join(files.where(F.col("action") == FROM_PREVIOUS).select("file"), "file", "left_semi").select(*made.columns)
            made = made.unionByName(copied)
        made.write.mode("overwrite").parquet(self.folder("rows", self.generation, number))
        files.select("file", "hash", "action").write.mode("overwrite").parquet(self.folder("commits", self.generation, number))

    def stats(self, spark: SparkSession, files: DataFrame) -> DataFrame:
        """One row: reused, reused_from_previous, parsed, unavailable, and incomplete, the files (file, hash) of the snapshot that aren't in as they are."""
        own = self.commits(spark)
        n = lambda a: F.count_if(F.col("action") == a).alias(a)
        done = own.where(F.col("action") != UNAVAILABLE).select("file", "hash").distinct()
        missing = files.select("file", "hash").join(done, ["file", "hash"], "left_anti").agg(F.count(F.lit(1)).alias("incomplete"))
        return own.agg(n(REUSED), n(FROM_PREVIOUS), n(PARSED), n(UNAVAILABLE)).withColumn("incomplete", missing.select("incomplete").scalar())
