"""Joins, upserts, pages and checks over DataFrames."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import operator
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import ancestors, directory
from ..session import cut

#: The bytes of a page, the length of a cursor.
PAGE_BYTES, CURSOR_CHARS = 96 * 1024, 4096
#: Digests that a node of a digest tree has below it, and the bits of a key's hash that a level of an inventory's tree tells apart.
FAN, NIBBLE = 64, 4


def span_join(left: DataFrame, right: DataFrame, key: str, how: str = "contains", bucket: int | None = None, kind: str = "inner") -> DataFrame:
    """Rows of left and right (both key, start, end) of one key whose spans match; right's columns get the prefix r_.

    how: contains (left holds right), overlaps (left.start <= right.end and left.end > right.start) or equal. bucket: spans are also
    joined by the blocks of this length that they touch, which splits up a key that has very many spans; the pair counts in
    the first block that both touch.
    """
    r = right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
    if how == "equal":
        return left.join(r, (F.col(key) == F.col(f"r_{key}")) & (F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end")), kind)
    match = {"contains": (F.col("start") <= F.col("r_start")) & (F.col("end") >= F.col("r_end")), "overlaps": (F.col("start") <= F.col("r_end")) & (F.col("end") > F.col("r_start"))}[how]
    on = F.col(key) == F.col(f"r_{key}")
    if not bucket:
        return left.join(r, on & match, kind)
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket)))
    left, r = left.withColumn("_block", blocks("start", "end")), r.withColumn("r__block", blocks("r_start", "r_end"))
    first = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("r_start") / bucket)) == F.col("_block")
    return left.join(r, on & (F.col("_block") == F.col("r__block")) & first & match).drop("_block", "r__block")


def last_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """An upsert: of each key the row that comes last; rows of new come after existing ones, and each by `order`."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order]))
    return both.withColumn("_at", at).where("_at = 1").drop("_at", "_new")


def first_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert if absent: existing rows, and of each other key the first new row by `order`."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = new.join(existing.select(*keys), list(keys), "left_anti").withColumn("_at", at).where("_at = 1").drop("_at")
    return existing.unionByName(fresh)


def delete_by(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def update_in(existing: DataFrame, chosen: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """existing with column set to value in the rows whose key is among chosen's."""
    marks = chosen.select(F.col(key).alias("_k")).distinct()
    return existing.join(marks, F.col(key) == F.col("_k"), "left").withColumn(column, F.when(F.col("_k").isNotNull(), value).otherwise(F.col(column))).drop("_k")


def first_existing(wanted: DataFrame, files: DataFrame, id_col: str, candidates: Column) -> DataFrame:
    """wanted's ids with the first of their candidate paths that is among files' path, or null."""
    each = wanted.select(id_col, F.posexplode(candidates).alias("at", "path"))
    hits = each.join(files.select("path").distinct(), "path").groupBy(id_col).agg(F.min_by("path", "at").alias("resolved"))
    return wanted.select(id_col).distinct().join(hits, id_col, "left")


def drift(expected: DataFrame, found: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """Where two inventories differ: key, and missing, unexpected or changed."""
    e, f = expected.select(key, F.col(digest).alias("_e"), F.lit(True).alias("_in_e")), found.select(key, F.col(digest).alias("_f"), F.lit(True).alias("_in_f"))
    kind = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_e").isNull(), "unexpected").when(~F.col("_e").eqNullSafe(F.col("_f")), "changed")
    return e.join(f, key, "full").select(key, kind.alias("problem")).where("problem is not null")


def digest_tree(rows: DataFrame, key: str, digest: str, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of an inventory of unique keys. leaves: its rows with `leaf`, the first `levels` hex digits of the key's SHA-256, which deal them evenly; nodes: level, prefix, digest, each over its 16
    children, level 0 the root. A leaf's digest is over its rows in order: take so many levels that 16 ** levels leaves have few rows each."""
    leaves = rows.withColumn("leaf", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, levels))
    pair = F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.col(digest), F.lit("\x1e")))
    joined = lambda child: F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("digest")
    level = leaves.groupBy(F.col("leaf").alias("prefix")).agg(joined(pair))
    nodes = level.select(F.lit(levels).alias("level"), "prefix", "digest")
    for depth in reversed(range(levels)):
        level = level.groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(joined(F.concat_ws(":", "prefix", "digest")))
        nodes = nodes.unionByName(level.select(F.lit(depth).alias("level"), "prefix", "digest"))
    return nodes, leaves


def tree_drift(expected: tuple[DataFrame, DataFrame], found: tuple[DataFrame, DataFrame], key: str, digest: str) -> DataFrame:
    """What drift() says of two inventories with digest trees of as many levels, from the roots down: of each level only the children of nodes that differ are compared, and only rows of leaves that
    differ are read. Where the trees are stored by level, and leaves in order, the rest isn't touched."""
    (a, a_rows), (b, b_rows) = expected, found
    levels = a.agg(F.max("level")).first()[0] or 0
    differ = None
    for depth in range(levels + 1):
        x, y = (t.where(F.col("level") == depth).select("prefix", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        if differ is not None:
            x, y = (t.join(differ, F.substring(t.prefix, 1, depth - 1) == F.col("_up"), "left_semi") for t in (x, y))
        differ = cut(x.join(y, "prefix", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("prefix").alias("_up")))
    some = lambda rows: rows.join(differ, F.col("leaf") == F.col("_up"), "left_semi")
    return drift(some(a_rows), some(b_rows), key, digest)


def reuse(files: DataFrame, before: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """files with whether the generation before has the same content under the same path."""
    old = before.select(F.col(key).alias("_k"), F.col(digest).alias("_d")).distinct()
    return files.join(old, (F.col(key) == F.col("_k")) & (F.col(digest) == F.col("_d")), "left").withColumn("reused", F.col("_k").isNotNull()).drop("_k", "_d")


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("_k")).distinct(), F.col(left_key) == F.col("_k"), "left_anti")


def artifacts(texts: DataFrame, text_col: str) -> DataFrame:
    """digest, json: each content once."""
    return texts.select(F.sha2(text_col, 256).alias("digest"), F.col(text_col).alias("json")).dropDuplicates(["digest"])


def intact(stored: DataFrame) -> DataFrame:
    """The artifacts whose content still has their digest."""
    return stored.where(F.sha2("json", 256) == F.col("digest"))


def ordered_digest(rows: DataFrame, by: Sequence[str], parts: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """A fingerprint of the rows of each group, in order: the root of a tree of SHA-256 over fixed ranges. Rows are hashed and ranked by range-partitioned sorts; FAN neighbours' digests at a time
    are joined and hashed, level upon level, until a group has one. No task has more than FAN digests of a node at once, however many rows a group has. Without groups
    an empty table has the digest of nothing."""
    own = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in parts]), 256)
    keys = [f"_g{i}" for i in range(len(groups))]
    order = [f"_b{i}" for i in range(len(by))] + ["_d"]
    hashed = rows.select(*[F.col(c).alias(k) for c, k in zip(groups, keys, strict=True)], *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], own.alias("_d"))
    total = [F.col(c).asc() for c in order]
    ranked = grouped_rank(hashed, keys, total, "_at") if keys else global_rank(hashed, total, "_at")
    level = ranked.select(*keys, (F.col("_at") - 1).alias("_at"), "_d")
    done = None
    while done is None or not level.isEmpty():
        nodes = level.groupBy(*keys, F.floor(F.col("_at") / FAN).alias("_at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), "").alias("_j"))
        nodes = nodes.select(*keys, "_at", F.sha2("_j", 256).alias("_d"))
        sizes = nodes.groupBy(*[F.col(k).alias(f"_s{k}") for k in keys]).agg(F.max("_at").alias("_last"))
        marked = cut(nodes.join(sizes, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]) if keys else nodes.withColumn("_last", sizes.select("_last").scalar()))
        root = marked.where("_last = 0").select(*keys, F.col("_d").alias("fingerprint"))
        done = root if done is None else done.unionByName(root)
        level = marked.where("_last > 0").drop("_last")
    named = done.select(*[F.col(k).alias(c) for c, k in zip(groups, keys, strict=True)], "fingerprint")
    if not groups and named.isEmpty():
        return named.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("fingerprint"))
    return named


class StaleCursor(ValueError):
    pass


def cursor(generation: str, query: Sequence[object], after: object) -> str:
    body = {"generation": generation, "query": hashlib.sha256(json.dumps(list(query)).encode()).hexdigest(), "after": after}
    return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")


def after(text: str | None, generation: str, query: Sequence[object], start: object) -> object:
    """Where a page begins; a cursor of another generation or query, or one too long, is refused."""
    if text is None:
        return start
    if len(text) > CURSOR_CHARS:
        raise StaleCursor("cursor is too long")
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        known = hashlib.sha256(json.dumps(list(query)).encode()).hexdigest()
        if body["generation"] != generation or body["query"] != known or type(body["after"]) is not type(start):
            raise StaleCursor("cursor belongs to another generation or query")
    except (ValueError, KeyError, TypeError) as e:
        raise e if isinstance(e, StaleCursor) else StaleCursor("cursor can't be read") from e
    return body["after"]


def keyset_page(rows: DataFrame, key: str, start: object, limit: int, size: Column | None = None, budget: int = PAGE_BYTES) -> DataFrame:
    """The next `limit` rows after `start` by key, as long as their sizes stay in the budget, with has_more. One look-ahead row more is
    read, so the page is a top-k and never sorts the table. A first row that is beyond the budget by itself is an error, not an empty page."""
    ahead = rows.where(F.col(key) > F.lit(start)).orderBy(key).limit(limit + 1)
    order = Window.orderBy(key)
    bytes_ = F.sum(size if size is not None else F.lit(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    all_ = Window.partitionBy()
    marked = ahead.withColumn("_at", F.row_number().over(order)).withColumn("_bytes", bytes_)
    alone = F.raise_error(F.lit("single_result_exceeds_budget")).cast("boolean")
    inside = F.when((F.col("_at") == 1) & (F.col("_bytes") > budget), alone).otherwise((F.col("_at") <= limit) & (F.col("_bytes") <= budget))
    marked = marked.withColumn("_in", inside).withColumn("has_more", F.sum(F.col("_in").cast("int")).over(all_) < F.count(F.lit(1)).over(all_))
    return marked.where("_in").drop("_at", "_bytes", "_in")


def pages(rows: DataFrame, key: str, limit: int, columns: Sequence[str], ahead: int = 10) -> Iterator[list[tuple]]:
    """All pages from a keyset, one after the other: a job fetches the rows of up to `ahead` pages, and no more than these are held. Keys are unique and not null."""
    at, more = None, True
    while more:
        later = rows if at is None else rows.where(F.col(key) > F.lit(at))
        found = later.select(key, *columns).orderBy(key).limit(limit * ahead + 1).toArrow()
        more = found.num_rows > limit * ahead
        keys, cells = found.column(0).to_pylist(), [c.to_pylist() for c in found.columns[1:]]
        for begin in range(0, min(found.num_rows, limit * ahead), limit):
            end = min(begin + limit, limit * ahead, found.num_rows)
            at = keys[end - 1]
            yield list(zip(*(c[begin:end] for c in cells), strict=True))


#: The most files and rows that a page with work caps examines.
PAGE_FILES, PAGE_EXAMINED = 10, 500


def capped_page(files: DataFrame, calls: DataFrame, match: Column, after: tuple[str, int] | None, limit: int, most_files: int = PAGE_FILES, most_examined: int = PAGE_EXAMINED) -> DataFrame:
    """The calls (file, ordinal) that a page examines, in order after a place, with `hit` (match) and on every row what the page says: next_file, next_ordinal (where the next begins after), exhausted, examined.

    A page ends at its `limit`-th hit, its `most_examined`-th call or its `most_files`-th file (file), whichever is first; files without calls count. A page that examines no call but
    isn't at the end has one row, whose ordinal is null. Top-k's of files and calls: nothing is sorted whole.

    A place should be one call's. Of calls that share one those without a hit come first, then by their other columns, so that a page is the same however its rows are dealt; the next page begins after the place.
    """
    from_file, from_ordinal = after or ("", -1)
    near = files.where(F.col("file") >= F.lit(from_file)).select("file").orderBy("file").limit(most_files + 1)
    near = near.withColumn("_rank", F.row_number().over(Window.orderBy("file")))
    some = near.where(F.col("_rank") <= most_files)
    later = (F.col("file") > F.lit(from_file)) | (F.col("ordinal") > F.lit(from_ordinal))
    ahead = calls.where(later & (F.col("file") >= F.lit(from_file))).join(F.broadcast(some.select("file")), "file").withColumn("hit", F.coalesce(match, F.lit(False)))
    rest = [F.col(f"`{f.name}`") for f in ahead.schema.fields if f.name not in ("file", "ordinal", "hit") and not re.search("map<|variant", f.dataType.simpleString())]
    total = [F.col("file"), F.col("ordinal"), F.col("hit"), *rest]
    ahead = ahead.orderBy(*total).limit(most_examined + 1)
    order = Window.orderBy(*total)
    before = F.coalesce(F.sum(F.col("hit").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = ahead.withColumn("_in", (F.row_number().over(order) <= most_examined) & (before < limit))
    stops = ahead.agg(F.coalesce(F.bool_or(~F.col("_in")), F.lit(False)).alias("_capped"), F.max(F.when(F.col("_in"), F.struct("file", "ordinal"))).alias("_last"), F.count_if("_in").alias("examined"))
    # after its last file a page stands behind all that the file has
    stops = stops.withColumn("_file", some.agg(F.max("file").alias("f")).select("f").scalar()).withColumn("_more", near.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() > most_files)
    end = F.when(F.col("_capped"), F.col("_last")).otherwise(F.struct(F.col("_file").alias("file"), F.lit((1 << 31) - 1).alias("ordinal")))
    stops = stops.select("examined", (~F.col("_capped") & ~F.col("_more")).alias("exhausted"), end["file"].alias("next_file"), end["ordinal"].cast("int").alias("next_ordinal"))
    shown = ahead.where("_in").drop("_in")
    return stops.join(shown, F.lit(True), "left").select(*shown.columns, "next_file", "next_ordinal", "exhausted", "examined")


#: The low bits of monotonically_increasing_id: a row's place in its partition.
PLACE = 33


#: Rows that a task of a rank over many rows reads.
TASK_ROWS = 1 << 18


def row_parts(rows: int, spark: SparkSession) -> int:
    """Partitions for so many rows: Spark's number, and more where a task would read more than TASK_ROWS of them, so that what one reads doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def global_rank(rows: DataFrame, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """row_number over all rows without bringing them into one task: one range-partitioned sort (over `parts`, if given), then each row's place in its partition is moved
    up by the number of rows before that. `order` has to be total. No window runs over the rows."""
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    placed = cut(dealt.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", PLACE)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_size"))  # a row a partition
    before = sizes.select("_p", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_p", part).join(F.broadcast(before), "_p")
    return ranked.withColumn(name, F.col("_m").bitwiseAND(F.lit((1 << PLACE) - 1)) + F.col("_before") + 1).drop("_p", "_m", "_before")


#: Rows of a group that one task sorts.
GROUP_ROWS = 1 << 17
#: Groups whose first ranks are broadcast.
FEW_GROUPS = 50_000


def largest_group(rows: DataFrame, by: Sequence[str]) -> int:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def grouped_rank(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, most: int = GROUP_ROWS, largest: int | None = None, parts: int | None = None) -> DataFrame:
    """row_number within groups of which any may hold most rows. Groups are counted first: where none has more than `most` rows it is a window, one shuffle by group; else the rank over all rows by
    group and order, less the rank at which the group begins, so that a group is spread over tasks. `order` has to be total within a group; nulls are a group. rows are read twice, unless the caller knows the largest group's size. parts: see `row_parts`."""
    if (largest_group(rows, by) if largest is None else largest) <= most:
        rows = rows.repartition(parts, *by) if parts else rows
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    ranked = global_rank(rows, [*[F.col(c).asc() for c in by], *order], "_rank", parts)
    starts = ranked.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_rank").alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    # few groups come to every task, so that no task gets a whole one
    starts = cut(starts)
    starts = F.broadcast(starts) if starts.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else starts
    return ranked.join(starts, same).withColumn(name, F.col("_rank") - F.col("_start") + 1).drop("_rank", "_start", *[f"_by{i}" for i in range(len(by))])


def split_offsets(rows: DataFrame, keep: Sequence[str], pieces: Column) -> DataFrame:
    """keep, place and the fields of pieces (an array of structs with n and skip: the lengths of a text's parts and of what stands between them), with
    start and end of every part. Running sums over the exploded parts: linear in a text, whatever their number."""
    split = rows.select(*keep, pieces.alias("_pieces")).withColumn("_row", F.monotonically_increasing_id())
    each = split.select(*keep, "_row", F.posexplode("_pieces").alias("place", "_x")).select(*keep, "_row", "place", "_x.*")
    upto = F.sum(F.col("n") + F.col("skip")).over(Window.partitionBy("_row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", upto - F.col("skip")).withColumn("start", F.col("end") - F.col("n")).drop("_row")


def text_lines(rows: DataFrame, keep: Sequence[str], text: Column) -> DataFrame:
    """keep, line (from 1), start and end of every line of a text, without its end."""
    pieces = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(x).cast("long").alias("n"), F.lit(1).alias("skip")))
    return split_offsets(rows, keep, pieces).select(*keep, (F.col("place") + 1).cast("long").alias("line"), "start", "end")


def hits(rows: DataFrame, keep: Sequence[str], text: Column, literal: Column) -> DataFrame:
    """keep, start and end of the occurrences of a literal, from the left and without overlap. Case counts; an empty literal occurs nowhere."""
    quoted = F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(text, quoted, -1)
    before = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))  # each of these has a hit after it
    pieces = F.transform(before, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.length(literal).cast("long").alias("skip")))
    at = split_offsets(rows.where((F.length(literal) > 0) & F.contains(text, literal)), keep, pieces)
    return at.select(*keep, F.col("end").alias("start"), (F.col("end") + F.col("skip")).alias("end"))


def observed(cited: DataFrame, served: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cited spans (keys, start, end) that lie in a served span of the same keys, such as a file and its digest."""
    s = served.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = [F.col(k) == F.col(f"_s{i}") for i, k in enumerate(keys)]
    return cited.join(s, [*same, F.col("_start") <= F.col("start"), F.col("_end") >= F.col("end")], "left_semi")


def touching(edges: DataFrame, sides: Sequence[str], value: object) -> DataFrame:
    """The edges one of whose sides is a value."""
    return edges.where(functools.reduce(operator.or_, [F.coalesce(F.col(c) == F.lit(value), F.lit(False)) for c in sides]))


def looked_up(rows: DataFrame, names: DataFrame, keys: Sequence[str], values: Sequence[str], default: object = None) -> DataFrame:
    """rows with a name table's values (one row for the keys: the first by its values, if there are more), such as the module that a local name was imported
    from in its file, or a module's family; default, or null, where it has none."""
    one = names.groupBy(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*values)).alias("_v"))
    out = rows.join(one, [F.col(k) == F.col(f"_n{i}") for i, k in enumerate(keys)], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("_v")[v], F.lit(default)).alias(v) for v in values])


def callers(functions: DataFrame, calls: DataFrame, name: str = "name") -> DataFrame:
    """Each function with the calls of its name; columns of calls get the prefix call_. A name alone doesn't tell which function is meant."""
    c = calls.select(*[F.col(x).alias(f"call_{x}") for x in calls.columns])
    return functions.join(c, F.col(name) == F.col(f"call_{name}"))


def first_origin(relationships: DataFrame, contexts: DataFrame, kind: str, purposes: Sequence[str]) -> DataFrame:
    """target, file, start: of each target the first relationship of a kind (by file and start) from a file of one of these purposes."""
    origins = contexts.where(F.col("purpose").isin(*purposes)).select("file")
    from_ = relationships.where(F.col("kind") == kind).join(origins, "file", "left_semi")
    return from_.groupBy("target").agg(F.min(F.struct("file", "start")).alias("o")).select("target", "o.file", "o.start")


def excluded_by(files: DataFrame, configs: DataFrame) -> DataFrame:
    """file, excluded_by: of each file (path) the configs (path, pattern: a regular expression, one row each) in a folder above it whose pattern fits its
    path from there, in order. Joined by folders, so no file meets every config."""
    c = configs.select(F.col("path").alias("config"), directory(F.col("path")).alias("folder"), "pattern")
    each = files.select(F.col("path").alias("file")).distinct()
    up = each.select("file", F.explode(ancestors(F.col("file"))).alias("folder"))
    inside = F.when(F.col("folder") == "", F.col("file")).otherwise(F.expr("substring(file, length(folder) + 2)"))
    fits = up.join(c, "folder").where(F.rlike(inside, F.col("pattern"))).groupBy("file").agg(F.array_sort(F.collect_set("config")).alias("excluded_by"))
    return each.join(fits, "file", "left").select("file", F.coalesce("excluded_by", F.array().cast("array<string>")).alias("excluded_by"))


def search(rows: DataFrame, file: str, text: str, literal: str, prefix: str = "", after_file: str = "", after_start: int = -1, limit: int = 30) -> DataFrame:
    """file, start, end: a page of a literal's occurrences in the files whose path has a prefix, after a place, in order. A top-k: nothing is sorted whole."""
    if not (T.SHORTEST <= len(literal) <= T.LONGEST) or "\0" in literal or not 1 <= limit <= 50:
        raise ValueError("a search has 3 to 200 characters, and a page 1 to 50 rows")
    some = rows.where(F.col(file).startswith(prefix) & (F.col(file) >= F.lit(after_file)))
    found = hits(some, [file], F.col(text), F.lit(literal))
    later = (F.col(file) > F.lit(after_file)) | (F.col("start") > F.lit(after_start))
    return found.where(later).orderBy(file, "start").limit(limit)


def gaps(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """The files (path) that have no context (file, capability) or none that is indexed."""
    known = contexts.select(F.col("file").alias("_f"), "capability")
    return files.join(known, F.col("path") == F.col("_f"), "left").where("_f is null or capability is null or capability != 'indexed'").drop("_f")


def first_rows(rows: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows in a total order: each task keeps its own first k, and no more than these are merged."""
    if k < 1:
        raise ValueError("a top-k has one row at least")
    return rows.orderBy(*order).limit(k)


def best_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; k small. Each task keeps its own first k before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= k).drop("_at")


def merged(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Evidence of several kinds as one table, each row with its kind first."""
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), *df.columns) for kind, df in parts])
