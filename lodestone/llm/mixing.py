"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a fixed hash of its id and text. A source's words are summed by hash bucket; walking the buckets finds the one
in which the running sum passes the source's budget. Only that bucket is refined, by the next BITS bits of the hash, and so
on LEVELS times; then one bucket is left, of at most a few documents, and the threshold is the bucket's end that comes nearer to the budget. Selecting is
a filter on the hash: nothing is sorted, and a smaller budget's documents are always among a larger one's.

Memory: a histogram has 2 ** BITS rows a source at most, whatever the input. A hot source is spread over all tasks,
since sums are formed before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_small

BITS, LEVELS = 12, 3
WEIGHTS = (5, 2, 1)


def row_hash(id_: Column, text: Column) -> Column:
    """The first BITS * LEVELS bits of the MD5 of id and text, so that rows without an id, or of one id, are told apart by their texts; null counts as empty."""
    name = F.concat_ws(" ", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size in words, and the 36-bit hash of id and text."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        row_hash(F.col(id_col), F.col(text_col)).alias("h"),
    )


def targets(sums: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size, target. sums has a row a source. By weight the sources share share * all sizes; none gets more than
    most * its own size, and what is over goes to the others by weight until none is above: with the sources in order of
    size to weight, the first so many stop at their limit, and the others get the same rate a weight."""
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int"))
    t = sums.withColumn("place", place).withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    t = t.withColumn("room", F.sum("source_size").over(all_) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("rate", F.col("room") / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Along this order the rate never falls while sources stop at their limit; the first source below its limit sets it.
    t = t.withColumn("rate", F.min(F.when(F.col("cap") > F.col("rate") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "place", "rate"))).over(all_)["rate"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("rate") * F.col("w"), F.col("cap"))).alias("target"))


def bucket(h: Column, level: int) -> Column:
    """The hash's bits down to this level."""
    return F.shiftright(h, BITS * (LEVELS - 1 - level))


def source_key(source: Column) -> Column:
    """A key that joins nulls too, and keeps them from the empty name."""
    return F.struct(F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("none"))


def thresholds(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """A row a source: s, source_size, target, times, below. Takes rows of s, source, size and h."""
    hist = cut(rows.groupBy("s", bucket(F.col("h"), 0).alias("b")).agg(F.sum("size").alias("words"), F.first("source").alias("source")))
    want = targets(hist.groupBy("s").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    want = want.select(source_key(F.col("source")).alias("s"), "source_size", "target", times.alias("times"))
    at = cut(want.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("upto", F.lit(0.0)))
    for level in range(LEVELS):
        if level:
            outer = at.where("b is not null").select("s", F.col("b").alias("outer"))
            inside = join_small(rows, outer, ["s"]).where(bucket(F.col("h"), level - 1) == F.col("outer"))
            hist = inside.groupBy("s", bucket(F.col("h"), level).alias("b")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("s").orderBy("b"))
        walk = join_small(hist.withColumn("cum", running), at.select("s", "rest", "upto"), ["s"]).withColumn("end", F.col("upto") + F.col("cum"))
        # The boundary is the first bucket that ends above the budget; what lies before it is in.
        edge = walk.where("end > rest").groupBy("s").agg(F.min(F.struct("b", (F.col("end") - F.col("words")).alias("before"), "end")).alias("e"))
        found = at.select("s", "source_size", "target", "times", "rest").join(edge, "s", "left")
        at = cut(found.select("s", "source_size", "target", "times", "rest", F.col("e.b").alias("b"), F.coalesce("e.before", F.lit(0.0)).alias("upto"), F.col("e.end").alias("end")))
    # The last boundary bucket goes in if its end is nearer to the budget than its start. Without a boundary all are in.
    nearer = ((F.col("end") - F.col("rest")) < (F.col("rest") - F.col("upto"))).cast("long")
    below = F.when(F.col("b").isNull(), F.lit(1 << BITS * LEVELS)).otherwise(F.col("b") + nearer)
    return at.select("s", "source_size", "target", "times", below.alias("below"))


#: How often a row of a source is taken.
COPIES = "times + cast(h < below as long)"


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken.

    A source whose target is r times its size and a rest takes each document r times, and once more those whose hash is
    below the source's threshold. Null texts have size 0; the null source is a source of its own, the last. Rows that tie
    in the hash (those of one id and text) are taken alike. Empty table: no rows. Other columns are not looked at. Deterministic.
    """
    rows = cut(sized(docs, id_col, text_col, source_col).withColumn("s", source_key(F.col("source"))))
    plan = thresholds(rows, weights, share, most)
    return join_small(rows, plan, ["s"]).select(F.col("id").alias(id_col), "size", "source_size", "target", F.expr(f"size * ({COPIES})").alias("taken"))


def mix_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as mixed: each row as many times as the mix takes it, all columns as they were. A row without words is taken as
    often as its hash says, but no more often than `most` allows."""
    slim = cut(sized(docs, id_col, text_col, source_col).withColumn("s", source_key(F.col("source"))))
    plan = thresholds(slim, weights, share, most).select("s", "times", "below")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key(F.col(source_col)).alias("s"), row_hash(F.col(id_col), F.col(text_col)).alias("h"))
    copies = join_small(tagged, plan, ["s"]).withColumn("copies", F.least(F.expr(COPIES), F.lit(math.ceil(most)))).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w,
      row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
r AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
      FROM w WINDOW b AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rate, (cap / w, place)) AS rate FROM r WHERE cap > rate * w),
t AS (SELECT source, source_size, least(cap, coalesce(l.rate * w, cap)) AS target FROM r LEFT JOIN l ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t),
q AS (SELECT *, target - times * source_size AS rest FROM p),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h)::DOUBLE AS "end" FROM g),
e AS (SELECT c.source, min(h) AS b, arg_min("end", h) AS "end", arg_min("end" - words, h) AS upto FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
      WHERE "end" > rest GROUP BY c.source),
k AS (SELECT q.source, source_size, target, times, CASE WHEN b IS NULL THEN 68719476736 ELSE b + ("end" - rest < rest - upto)::BIGINT END AS below
      FROM q LEFT JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (times + (h < below)::BIGINT))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
