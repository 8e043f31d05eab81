"""URL filters: a stated list of rules, and beyond it association rules mined by FP-growth.

Transactions are the tokens of URLs that the list judges, with its verdict as a label among them. Spark's FP-growth finds the frequent
combinations; rules that end in a verdict stay if confident, frequent, and more confident than any rule of fewer of
their tokens. They are matched by an inverted index from token to rules: a rule fits a URL that has all of its tokens.

Every label and suffix of the host and every part of the path is a token. Two exact reductions keep mining small: only frequent tokens can be part of a
frequent combination; and tokens that the very same URLs have are one class, of which one stands for all, since a rule with one of
them is as confident and as frequent with any other. In matching, a URL has a class if it has any of its tokens. Frequent tokens are at most a URL's mean number of
tokens over SUPPORT, whatever the input.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, join_small
from .components import reshuffled

SUPPORT, CONFIDENCE = 0.005, 0.8
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, up to / ? or #, A-Z lower-cased; then up to ? or #. Both empty without ://."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """The host's labels and suffixes, the path's parts with their place (digits as 0), and its extension; each once."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))
    of_host = F.concat(suffixes, F.transform(labels, lambda x: F.concat(F.lit("label="), x)))
    of_path = F.transform(parts, lambda x, i: F.concat(F.lit("part"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"[0-9]+", "0")))
    kind = F.concat(F.lit("kind="), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit("")))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(host != "", of_host).otherwise(none), of_path, F.array_compact(F.array(kind))))


def among(found: Column, words: Sequence[str]) -> Column:
    return F.array_sort(F.array_intersect(found, F.from_json(F.lit(json.dumps(list(words))), "array<string>")))  # one constant, however many there are


def classes(labelled: DataFrame, support: float, n: int) -> DataFrame:
    """token, class: the tokens that at least support * n rows have, and the first by length and name of those that the same rows have."""
    marked = labelled.select("tokens", F.monotonically_increasing_id().alias("row"))
    each = marked.select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("h"), F.xxhash64("row", F.lit(1)).alias("h2"))
    rows = [F.count(F.lit(1)).alias("have"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("h2").alias("b")]
    frequent = cut(each.groupBy("token").agg(*rows).where(F.col("have") >= support * n))
    first = frequent.groupBy("have", "a", "b").agg(F.min(F.struct(F.length("token"), "token"))["token"].alias("class"))
    return frequent.join(first, ["have", "a", "b"]).select("token", "class")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules, classes) from rows of tokens and verdict. rules: rule_id, tokens (classes, sorted), verdict, confidence, support; classes: token, class. Both are bounded."""
    own = cut(classes(labelled, support, labelled.count()))
    words = [r[0] for r in own.select("token").collect()]
    known = labelled.select(among(F.col("tokens"), words).alias("known"), "verdict")
    sets = known.select("known").distinct().select("known", F.explode("known").alias("token")).join(F.broadcast(own), "token").groupBy("known").agg(F.array_sort(F.collect_set("class")).alias("items"))
    named = join_small(known, cut(sets), ["known"], "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "verdict")
    baskets = named.select(F.array_append("items", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("verdict=") & ~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 99).alias("verdict"), "confidence", "support"))
    # a rule goes that one of one token less, or its own part of that, equals or beats; what beats a part has beaten that part's rule, too
    parts = rules.where("size(tokens) > 1").select("verdict", F.col("tokens").alias("whole"), F.col("confidence").alias("c"), F.explode("tokens").alias("less"))
    parts = parts.select("verdict", "whole", "c", F.array_remove("whole", F.col("less")).alias("tokens"))
    best, longest = rules.withColumn("best", F.col("confidence")), rules.agg(F.max(F.size("tokens"))).first()[0] or 1
    for _ in range(longest - 1):  # best: the most confident rule of some of the tokens; one more token each time
        up = parts.join(best.select("tokens", "verdict", "best"), ["tokens", "verdict"]).groupBy(F.col("whole").alias("tokens"), "verdict").agg(F.max("best").alias("below"))
        best = cut(rules.join(up, ["tokens", "verdict"], "left").withColumn("best", F.greatest("confidence", F.coalesce("below", F.lit(0.0)))))
    kept = best.where("below is null or confidence > below") if "below" in best.columns else best
    return cut(kept.select("tokens", "verdict", "confidence", "support").withColumn("rule_id", F.xxhash64("tokens", "verdict"))), own


def match(rows: DataFrame, rules: DataFrame, own: DataFrame) -> DataFrame:
    """rows, which have tokens, with the verdict of the most confident rule that fits (then the best supported; allow before block), or null."""
    index = rules.select("rule_id", F.explode("tokens").alias("class"), F.size("tokens").alias("n"), "verdict", "confidence", "support").join(own, "class")
    words = [r[0] for r in index.select("token").distinct().collect()]  # among the frequent ones
    rows = rows.withColumn("known", among(F.col("tokens"), words))
    sets = cut(rows.select("known").distinct())
    hits = sets.select("known", F.explode("known").alias("token")).join(reshuffled(index, "token"), "token").dropDuplicates(["known", "rule_id", "class"])
    fits = hits.groupBy("known", "rule_id").agg(F.count(F.lit(1)).alias("have"), F.first("n").alias("n"), F.first("verdict").alias("verdict"), F.first("confidence").alias("c"), F.first("support").alias("s")).where("have = n")
    best = cut(fits.groupBy("known").agg(F.max(F.struct("c", "s", (F.col("verdict") == "allow").alias("a"), "verdict"))["verdict"].alias("mined")))
    return join_small(rows, best, ["known"], "left").drop("known")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, labels: DataFrame | None = None) -> DataFrame:
    """A row per row of pages: id, host, path, rule, verdict. What the list leaves open gets the mined rules' verdict, and allow where
    none fits. They are mined from labels (id, verdict: allow or block) where there are any, else from what the list judges. A null URL or one without :// has neither host nor path, no tokens, and is allowed. Repeated rows count as often
    as they are there. Empty table, or none that the list judges: nothing is mined. Other columns are not looked at."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    if labels is None:
        labelled = rows.where("listed is not null").select("tokens", F.col("listed").alias("verdict"))
    else:
        labelled = rows.join(labels.select(F.col(id_col).alias("id"), "verdict"), "id").select("tokens", "verdict")
    labelled = cut(labelled)
    if labelled.limit(1).count():
        rows = match(rows, *mine(labelled, support, confidence))
    else:
        rows = rows.withColumn("mined", F.lit(None).cast("string"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"))
