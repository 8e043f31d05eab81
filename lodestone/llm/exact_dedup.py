"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row is dealt to one of R = FAN ** k runs by a hash of its id and place. A run is sorted by digest; the leaf level keeps, of each digest
of a run, the identifier that stays and the number of rows it stands for. Then runs are merged in rounds, FAN at a time
(a binomial tree of degree FAN): the exchange brings the FAN runs of a parent together, slice by slice of the digests,
the sort merges them, and a running comparison along the sorted run keeps one row a digest. After k rounds one run is
left. A digest is SHA-256; every merge verifies length and a second, independent hash of its rows and goes on separately
where they differ. Then the tree is descended: each leaf entry looks up the root's decision and hands it to its own rows.

No task ever gets a whole group: a group of n copies has n / R rows in a leaf cell and at most FAN in a later one.
Texts are never shuffled, only digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, salts

FAN = 8
KEY = ["sha", "size", "check"]


def leaf_rows(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """id, sha (binary), size, check, run for every row; null texts are empty."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("check"),
        F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(runs)).alias("run"),
    )


def merge_round(level: DataFrame, keep: str) -> DataFrame:
    """FAN neighbouring runs into one: sorted by digest, best identifier first, one row a digest stays."""
    best = F.col("keep").desc_nulls_last() if keep == "max" else F.col("keep").asc_nulls_last()
    merged = level.withColumn("run", F.floor(F.col("run") / FAN))
    run = Window.partitionBy("run", *KEY)
    return (
        merged.withColumn("_at", F.row_number().over(run.orderBy(best)))
        .withColumn("n", F.sum("n").over(run.orderBy(best).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .where("_at = 1")
        .drop("_at")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. keep: "max" or "min", which id of a group
    stays. Ties: rows with the same id and text are all marked kept (see `dedup_rows`). A null id loses to any other and is kept
    only where its whole group has none. Empty table: no rows. Other columns are not looked at.
    """
    k = 1
    while FAN**k < salts(docs):
        k += 1
    rows = cut(leaf_rows(docs, id_col, text_col, FAN**k))
    fold = F.max if keep == "max" else F.min
    leaves = rows.groupBy("run", *KEY).agg(fold("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    level = leaves
    for _ in range(k):
        level = merge_round(level, keep)
    root = level.select(*KEY, F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))
    decided = leaves.select("run", *KEY).join(root, KEY)
    return rows.join(decided, ["run", *KEY]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows whose text another row has that stays; all columns as they were. Of rows that share id and text,
    one stays."""
    held = exact_dedup(docs, id_col, text_col, keep).where("kept").groupBy(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_sha"))
    stay = cut(held.agg(F.count(F.lit(1)).alias("_n")))
    key = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    kept = rows.join(stay, F.expr("id <=> _id and key = _sha"))
    return kept.where("_n = 1").union(kept.where("_n > 1").dropDuplicates(["id", "key"])).select("row.*")


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
"""
