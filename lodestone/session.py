"""Sessions and tables."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names, so that a lost executor costs no recomputation. Where it is
    unset, in a folder of our own, but only if driver and tasks are one process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


#: Characters of texts that a task sorts the tokens or lines of: some hundred thousand rows.
TASK_CHARS = 1 << 21


def dealt(texts: DataFrame, rows: DataFrame, chars: Column, key: str) -> DataFrame:
    """rows by key over so many partitions that each has about TASK_CHARS characters of texts, which are counted first: what a task sorts doesn't grow with the input. Their number is given, so that
    Spark doesn't join small partitions whose rows are many once they are exploded."""
    total = texts.agg(F.sum(F.length(chars).cast("long"))).first()[0] or 0
    return rows.repartition(max(1, -(-total // TASK_CHARS)), key)
