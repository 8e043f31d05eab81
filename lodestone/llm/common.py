"""What the operators of this package share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the separators of words.
SPACES = " \t\n\x0b\x0c\r"
#: A word, for Java and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(df: DataFrame) -> None:
    """The session's spark.checkpoint.dir is where lineage is cut. Where it is unset, a folder of our own, but only if driver and tasks
    are one process: on a cluster that folder would be another one on every machine."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="lodestone-"))


#: Spark's setting that removes a query's shuffle files when it ends, not when the driver happens to collect its garbage. It holds for queries made while it is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: a lost executor costs no recomputation. The shuffle files that led to it go."""
    shared_dir(df)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. The built-in lower() does just that to ASCII texts, and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


HELD: dict = {}


def in_worker(key, make):
    """What make() gives, kept by a Python worker from task to task until another key is asked for: workers go from operator to
    operator, and no more than one's model and words stay in memory."""
    if key not in HELD:
        HELD.clear()
        pa.default_memory_pool().release_unused()
        HELD[key] = make()
    return HELD[key]


def salts(df: DataFrame, least: int = 64) -> int:
    """How many parts a hot group is dealt over: more with more shuffle partitions, which follow the data."""
    return max(least, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", bound: int = 50_000) -> DataFrame:
    """df joined to a table of one row a key whose keys may be hot in df. Up to `bound` rows (counted) small is broadcast;
    beyond it, each key is dealt over salts, so that no task gets a whole key of df. A row's salt is a hash of what is in it, so that a task
    that runs again deals its rows as before."""
    if small.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(small), list(on), how)
    n = 32
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    return df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")
