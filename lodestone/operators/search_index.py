"""Literal search by a trigram index: posting lists of trigrams by chunk, kept as tables of a generation.

Texts are cut into chunks of CHUNK code points that overlap by OVERLAP, numbered in order of file and place. The postings (tri, chunk) are stored in order of
trigram, so that a needle's are a few row groups, and the chunks in order of number, so that candidates are read by their pages. A search counts the needle's
trigrams, intersects the rarest, and reads and checks only the chunks that have them all; nothing else of the texts is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import relations

#: Three code points from here.
TRIGRAM = r"(?s)(?=([^\uDC00-\uDFFF]..))"
#: Trigrams that are intersected, and the chunks that a page of matches reads.
RAREST, PAGE_CHUNKS = 4, 10
#: The most matches of a page, and what is said of every search.
MOST_MATCHES, CAVEAT, PAGE_REASON = 50, "literal_matches_not_dataflow", "page_budget"


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in code points."""
    # one match a code point: none begins at the second half of a pair
    triples = F.regexp_extract_all(text, F.lit(TRIGRAM), F.lit(1))
    return F.when(F.length(text) >= 3, F.array_distinct(triples)).otherwise(F.array().cast("array<string>"))


def needle_trigrams(needle: str) -> list[str]:
    return sorted({needle[i : i + 3] for i in range(len(needle) - 2)})


def checked(needle: str, limit: int) -> None:
    if not T.SHORTEST <= len(needle) <= T.LONGEST or "\0" in needle or not 1 <= limit <= MOST_MATCHES:
        raise ValueError(f"a search has {T.SHORTEST} to {T.LONGEST} characters, and a page 1 to {MOST_MATCHES} rows")


def chunked(rows: DataFrame, file: str, text: str) -> DataFrame:
    """chunk (numbered from 1 in order of file and start), file, start, text of rows, whose file is unique. Null texts have none."""
    each = rows.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.explode(T.chunks(F.col(text))).alias("_c")).select("file", F.col("_c.start").alias("start"), F.col("_c.text").alias("text"))
    return relations.global_rank(each, [F.col("file").asc(), F.col("start").asc()], "chunk").select("chunk", "file", "start", "text")


def postings(chunks: DataFrame) -> DataFrame:
    """tri, chunk: each trigram of a chunk once."""
    return chunks.select(F.explode(trigrams(F.col("text"))).alias("tri"), "chunk")


def candidates(posted: DataFrame, needle: str, after: int = 0) -> DataFrame:
    """chunk: those from `after` on that have the needle's rarest trigrams. Only the needle's postings are read; their counts, at most as many as it has trigrams, come to the
    driver."""
    wanted = needle_trigrams(needle)
    later = posted.where(F.col("tri").isin(wanted) & (F.col("chunk") >= after))
    counts = {r.tri: r["count"] for r in later.groupBy("tri").count().collect()}
    if len(counts) < len(wanted):  # one that is nowhere
        return posted.select("chunk").limit(0)
    rarest = sorted(wanted, key=lambda t: (counts[t], t))[:RAREST]
    return posted.where(F.col("tri").isin(rarest) & (F.col("chunk") >= after)).groupBy("chunk").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(rarest)).select("chunk")


def matches(chunks: DataFrame, needle: str) -> DataFrame:
    """chunk, file, start, end of the needle's occurrences that begin in a chunk's own part, from its left and without overlap."""
    found = relations.hits(chunks.withColumnRenamed("start", "_start"), ["chunk", "file", "_start"], F.col("text"), F.lit(needle))
    return found.where(F.col("start") < T.CHUNK).select("chunk", "file", (F.col("_start") + F.col("start")).alias("start"), (F.col("_start") + F.col("end")).alias("end"))


def search_all(chunks: DataFrame, posted: DataFrame, needle: str, prefix: str = "") -> DataFrame:
    """file, start, end of all matches in the files whose name has a prefix. Of posted, which may be `postings` as they are worked out, the needle's are kept, and read twice."""
    checked(needle, 1)
    posted = cut(posted.where(F.col("tri").isin(needle_trigrams(needle))))
    read = chunks.join(candidates(posted, needle), "chunk", "left_semi").where(F.col("file").startswith(prefix))
    return matches(read, needle).select("file", "start", "end")


def write(root: str, generation: int, rows: DataFrame, file: str, text: str, files_per_table: int | None = None) -> None:
    """The index of rows as two tables of a generation below root: chunks by number, and postings by trigram."""
    spark = rows.sparkSession
    n = files_per_table or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = f"{root}/chunks/generation={generation}"
    chunked(rows, file, text).repartitionByRange(n, "chunk").sortWithinPartitions("chunk").write.mode("errorifexists").parquet(base)
    posted = postings(spark.read.parquet(base)).repartitionByRange(n, "tri", "chunk").sortWithinPartitions("tri", "chunk")
    posted.write.mode("errorifexists").parquet(f"{root}/postings/generation={generation}")


@dataclass
class Page:
    matches: list[tuple[str, int, int]]
    cursor: str | None
    completion: str
    unindexed: int
    reasons: list[str]


def page(spark: SparkSession, root: str, generation: int, needle: str, prefix: str = "", cursor: str | None = None, limit: int = 30, gaps: DataFrame | None = None) -> Page:
    """The next matches in order of chunk and place: at most `limit`, of at most PAGE_CHUNKS candidate chunks, with the cursor of what follows, which an empty page may have too.

    completion is partial while there is a cursor, or files that aren't wholly indexed (gaps, see `relations.gaps`). A cursor of another generation or query is refused.
    """
    checked(needle, limit)
    chunk, place = relations.after(cursor, str(generation), [needle, prefix], [0, 0])
    posted = spark.read.parquet(f"{root}/postings/generation={generation}")
    chunks = spark.read.parquet(f"{root}/chunks/generation={generation}")
    found = candidates(posted, needle, chunk)
    if prefix:
        found = found.join(chunks.where(F.col("file").startswith(prefix)).select("chunk"), "chunk", "left_semi")
    ids = [r[0] for r in found.orderBy("chunk").limit(PAGE_CHUNKS + 1).collect()]
    read = chunks.where(F.col("chunk").isin(ids[:PAGE_CHUNKS]))  # a filter on the stored order: only their pages are read
    own = F.struct("chunk", F.col("start").alias("place"))
    rows = matches(read, needle).where(own >= F.struct(F.lit(chunk).cast("long").alias("chunk"), F.lit(place).cast("long").alias("place"))).orderBy("chunk", "start").limit(limit + 1).collect()
    following = None
    if len(rows) > limit:
        following = [rows[limit].chunk, rows[limit].start]
    elif len(ids) > PAGE_CHUNKS:
        following = [ids[PAGE_CHUNKS], 0]
    missing = gaps.count() if gaps is not None else 0
    text = relations.cursor(str(generation), [needle, prefix], following) if following else None
    reasons = [CAVEAT, *([PAGE_REASON] if text else [])]
    return Page([(r.file, r.start, r.end) for r in rows[:limit]], text, "partial" if text or missing else "complete", missing, reasons)
