"""Near-duplicates by b-bit MinHash.

Each document's distinct shingles give HASHES minima. Bands of ROWS minima find candidates; of each minimum the low BITS bits are kept and
packed into longs, and the share of equal groups, counted by bits and corrected for groups that agree by chance, estimates the
similarity of two documents. Pairs whose estimate isn't far below the limit are confirmed on the full sets.

Documents with equal sets are one class, so copies make no pairs. Of a band's bucket, every class is paired with one leader only,
the member with most company. What is linked is merged. Where a bucket then still has members of different components, those apart from their leader's go through
an exact join on the rarest of their shingles. So no bucket emits all its pairs, and no link between components is lost.
At a similarity of 0.75 two documents share no bucket once in 190,000 times; at 0.8, once in 25 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salts
from .components import components, reshuffled
from .shingles import shingle_set, word_hashes

WIDTH, LIMIT = 5, 75
HASHES, ROWS, BITS = 128, 4, 2
LONGS = HASHES * BITS // 64
#: The estimate's standard deviation at 0.75 is 0.046; pairs 6 of them below the limit are left out.
SLACK = 0.28
#: Sizes of a class differ by this factor.
CLASS = 1.1


def minima(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set, over blocks of shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        h = (seeds[0][:, None] ^ x[i : i + 4096]) * seeds[1][:, None]
        h ^= h >> np.uint32(15)
        h *= seeds[2][:, None]
        np.minimum(least, h.min(1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, in longs."""
    per = 64 // BITS
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), 1).astype(np.int64)


def seeds() -> np.ndarray:
    r = np.random.default_rng(20240229).integers(0, 1 << 32, (3, HASHES), np.uint32)
    r[1:] |= np.uint32(1)
    return r


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n_shingles, set_key (a 128-bit hash of the set, null if it is empty), buckets (a hash for each band), sig (longs)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seed = word_hashes(), seeds()
        band = np.arange(HASHES // ROWS, dtype=np.uint64)[:, None]
        for batch in batches:
            sizes, keys, buckets, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text or b"", width, hashes)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), buckets.append(None), sigs.append(None)
                    continue
                least = minima(s, seed)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                rows = np.concatenate([band, least.reshape(-1, ROWS).astype(np.uint64)], 1)
                buckets.append([xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rows])
                sigs.append(packed(least))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "set_key", "buckets", "sig"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, n_shingles long, set_key binary, buckets array<long>, sig array<long>")


def estimate(a: Column, b: Column) -> Column:
    """The collision-corrected similarity of two packed signatures."""
    ones = int("01" * 32, 2)
    differ = sum(F.bit_count((a[i].bitwiseXOR(b[i])).bitwiseOR(F.shiftright(a[i].bitwiseXOR(b[i]), 1)).bitwiseAND(F.lit(ones))) for i in range(LONGS))
    chance = 1 / (1 << BITS)
    return ((1 - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def of_nodes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text (binary) of the documents in nodes (id), each text of an id once."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(nodes, "id", "left_semi")
    return texts.groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("id", "text")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, limit: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= limit * union. Only the texts of pairs are moved. The partners of an a are dealt over slices, and
    each slice has the text of a once, before theirs."""
    texts = cut(of_nodes(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), id_col, text_col))
    pairs = pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(salts(docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, own = word_hashes(), None, []
        for batch in batches:
            found = []
            for a, slice_, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, slice_) != now:
                    now, own = (a, slice_), []
                s = shingle_set(text, width, hashes)
                if b is None:
                    own.append(s)  # one, but for ids that have several texts
                    continue
                for x in own:
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if 100 * both >= limit * (len(x) + len(s) - both):
                        found.append((a, b))
                        break
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    members = pairs.join(reshuffled(texts.withColumnRenamed("id", "b"), "b"), "b").select("a", "slice", "b", "text")
    leaders = pairs.select("a", "slice").distinct().join(reshuffled(texts.withColumnRenamed("id", "a"), "a"), "a").select("a", "slice", F.lit(None).cast("long").alias("b"), "text")
    both = leaders.union(members).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long").distinct()


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")


def prefix_links(rest: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, limit: int) -> DataFrame:
    """The links between documents of rest (node, component, apart) of different components of which one is apart, exactly: a prefix
    filter over their sets. Shingles stand in order of how few of these documents have them, those of one document alone left
    out. Two sets of sizes a and b as alike as the limit share limit * (a + b) / (100 + limit) shingles, so of either as many have to
    be left from the first that they share on. A document thus looks for partners by classes of their size, each by no more of its
    shingles than that class asks for; one that is far from all others has too few shared ones to meet any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = of_nodes(docs, rest.select(F.col("node").alias("id")), id_col, text_col).mapInArrow(run, "node long, shingles array<long>").where("size(shingles) > 0")
    sets = cut(sets.join(rest, "node").withColumn("set_id", F.xxhash64("node", "shingles")))
    each = sets.select("set_id", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(reshuffled(common, "shingle"), "shingle").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    least, most = F.expr(f"cast(ceil({limit} * n / 100) as int)"), F.expr(f"cast(floor(100 * n / {limit}) as int)")
    tried = sets.join(shared, "set_id").select("set_id", "component", "apart", F.size("shingles").alias("n"), "shared")
    tried = tried.select("*", size_class(F.col("n")).alias("own"), F.explode(F.sequence(size_class(least), size_class(most))).alias("other"))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(CLASS), F.col("other")) - 1e-6))
    tried = tried.withColumn("places", F.size("shared") - F.ceil(limit * (F.col("n") + smallest) / F.lit(100.0 + limit) - 1e-9).cast("int") + 1).where("places > 0")
    prefix = tried.select("set_id", "component", "apart", "n", "own", "other", F.size("shared").alias("all"), F.expr("posexplode(slice(shared, 1, places))").alias("at", "s"))
    prefix = cut(prefix.select("set_id", "component", "apart", "n", "own", "other", (F.col("all") - F.col("at")).alias("left"), F.col("s.shingle").alias("shingle")))
    x, y = prefix.where("apart").alias("x"), prefix.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.other") == F.col("y.own")) & (F.col("x.own") == F.col("y.other"))
    new = (F.col("x.component") != F.col("y.component")) & (~F.col("y.apart") | (F.col("x.set_id") < F.col("y.set_id")))
    like = (100 + limit) * F.least("x.left", "y.left") >= limit * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, meet & new & like).select(F.col("x.set_id").alias("sa"), F.col("y.set_id").alias("sb")).distinct()
    of = lambda k: reshuffled(sets.select(F.col("set_id").alias(f"s{k}"), F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")), f"s{k}")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(of("a"), "sa").join(of("b"), "sb").where(100 * both >= limit * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the least id it is linked with over any number of links, itself
    included), kept (whether that is its own).

    Linked are documents whose sets of shingles have 100 * intersection >= limit * union. A null or wordless text has no
    shingles and no links. Rows with one id are one document, which has the links of each. A null id has its group's
    component, or none. Empty table: no rows. Other columns are not looked at.
    """
    signed = cut(sign(docs, id_col, text_col, width))
    classes = signed.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("node"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    classes = cut(classes)
    sigs = classes.select("node", "sig")
    # rows with one id are one document: the few ids that repeat link the classes of their sets
    ids = signed.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    same = signed.where("set_key is not null").select("id", "set_key").distinct().join(ids, "id", "left_semi")
    same = same.join(reshuffled(classes.select("set_key", "node"), "set_key"), "set_key").where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()

    members = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowd = cut(members.join(reshuffled(shared, "bucket"), "bucket"))
    # a bucket's leader is the member that has most company in all its buckets, the likeliest to be like the others
    company = crowd.groupBy("node").agg((F.sum("n") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("company"))
    leaders = crowd.join(company, "node").groupBy("bucket").agg(F.max_by("node", "company").alias("leader"))
    crowd = cut(crowd.select("bucket", "node").join(reshuffled(leaders, "bucket"), "bucket"))
    stars = crowd.where("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = F.lit(limit / 100 - SLACK)
    with_sigs = stars.join(reshuffled(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"), "b")
    with_sigs = with_sigs.join(reshuffled(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a"), "a")
    likely_stars = cut(with_sigs.where(estimate(F.col("sa"), F.col("sb")) >= likely).select("a", "b"))
    links = cut(confirm(likely_stars, docs, id_col, text_col, width, limit).union(same))
    first = cut(components(links))

    # Buckets whose members aren't all in one component: those apart from their leader may have links to others.
    of = lambda name: reshuffled(first.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}")), name)
    placed = crowd.where("leader != node").join(of("node"), "node", "left").join(of("leader"), "leader", "left")
    placed = cut(placed.select("bucket", "node", F.coalesce("c_node", "node").alias("own"), F.coalesce("c_leader", "leader").alias("led")))
    open_ = placed.groupBy("bucket").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x != y").select("bucket")
    rest = placed.join(reshuffled(open_, "bucket"), "bucket").groupBy("node").agg(F.max("own").alias("component"), F.max(F.col("own") != F.col("led")).alias("apart"))
    more = cut(prefix_links(cut(rest), docs, id_col, text_col, width, limit))
    last = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if more.limit(1).count() else first

    groups = classes.select("set_key", "node").join(last, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n_shingles", "set_key").join(reshuffled(groups, "set_key"), "set_key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.expr("id <=> coalesce(component, id)").alias("kept"))


def near_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """docs with one document of each component, that of the least id; columns unchanged. Rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, width, limit).where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
