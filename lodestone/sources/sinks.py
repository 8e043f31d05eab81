"""Sinks: generations, artifacts and reports. Writes are whole folders, committed by Spark's protocol."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_escape
from ..operators.relations import artifacts
from ..session import cut


def write_generation(df: DataFrame, root: str, table: str, number: int) -> None:
    """A generation is written once; a reader names the generation it wants, so it sees all of it or none."""
    df.write.mode("errorifexists").parquet(f"{root}/{table}/generation={number}")


def put_artifacts(texts: DataFrame, text_col: str, stored: DataFrame | None, path: str) -> DataFrame:
    """Appends the contents that aren't stored yet; returns digest, json of what was new."""
    new = artifacts(texts, text_col)
    if stored is not None:
        new = new.join(stored.select("digest"), "digest", "left_anti")
    new = cut(new)  # what is written is what is returned, worked out once
    new.write.mode("append").parquet(path)
    return new


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table, escaped: value."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(markdown_escape(F.col(c).cast("string")), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))


def write_report(df: DataFrame, path: str, columns: list[str], order: list[Column | str], lists: Mapping[str, DataFrame] | None = None) -> None:
    """The folders json and markdown below path, in order, and one of JSON lines for each of lists, such as candidates and follow-ups. All are written beside path first and take its place when they
    are complete: a write that fails leaves the report that was there."""
    spark = df.sparkSession
    ordered = cut(df.orderBy(*order))  # sorted once
    new, old = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}", f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        ordered.write.json(f"{new}/json")
        markdown_table(ordered, columns).write.text(f"{new}/markdown")
        for name, rows in (lists or {}).items():
            rows.write.json(f"{new}/{name}")
    except BaseException:
        fs.delete(hadoop.Path(new), True)
        raise
    if fs.exists(at):
        fs.rename(at, hadoop.Path(old))
    if not fs.rename(hadoop.Path(new), at):
        fs.rename(hadoop.Path(old), at)
        raise OSError(f"{path} can't be replaced")
    fs.delete(hadoop.Path(old), True)
