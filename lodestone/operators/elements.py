"""Elements, attributes and texts of HTML templates with their spans, in DataFrame operations.

A page is lexed by one alternation: comments, raw elements up to their end tag, declarations, and tags whose attribute values may hold any
character in quotes. What stands between tokens is text. Offsets are running sums. Opening and closing tags are matched by running depth: each
name's tags have depths of their own, and tags of one name and depth alternate, so an end tag is the next one of its depth. All windows are by page, whose rows
are one page's tokens; linear in a page but for sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: Elements without an end tag, those whose text is raw, those that a sibling of their name ends, and attributes that bind HTML.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style textarea title xmp iframe noembed noframes".split()
SIBLING_ENDS = "p li dt dd tr td th option".split()
HTML_BINDINGS = ("[innerhtml]", "v-html")

#: What stands in a tag after its name: quotes count after = only, as in HTML.
INSIDE = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
NAME = r"[a-zA-Z][^\s/>]*+"
#: A raw element's start tag with its text: what follows up to its own end tag.
RAW_TOKEN = "|".join(rf"<{n}(?=[\s/>]){INSIDE}>.*?(?=</{n}[\s/>]|\z)" for n in RAW)
LEXER = rf"(?is)<!--.*?(?:-->|\z)|{RAW_TOKEN}|<[!?][^>]*+>|</?{NAME}{INSIDE}>"
START_TAG = rf"(?is)^<{NAME}{INSIDE}>"
ATTRIBUTE = r"(?s)([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>`]++))?+"


def length(x: Column) -> Column:
    return F.coalesce(F.length(x), F.lit(0)).cast("long")


def pieces(text: Column, pattern: str) -> Column:
    """Gaps and matches of a pattern in turn: structs of text and whether it matched."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(x.alias("t"), F.lit(False).alias("hit")))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("t"), F.lit(True).alias("hit")))
    return F.flatten(F.zip_with(gaps, found, lambda g, m: F.array_compact(F.array(g, m))))


def lexed(pages: DataFrame, keep: list[str], html: Column) -> DataFrame:
    """keep, _row, place, start, end, kind (text, comment, declaration, open, close), name and, of opening tags, t of every token; a raw element's text is a token of its own."""
    rows = pages.select(*keep, F.coalesce(html, F.lit("")).alias("_html")).withColumn("_row", F.monotonically_increasing_id())
    parts = F.flatten(F.transform(pieces(F.col("_html"), LEXER), split_raw))
    each = rows.select(*keep, "_row", F.posexplode(parts).alias("place", "x")).select(*keep, "_row", "place", F.col("x.t").alias("t"), F.col("x.hit").alias("hit"))
    t = F.col("t")
    kind = F.when(~F.col("hit"), "text").when(t.startswith("<!--"), "comment").when(t.startswith("<!") | t.startswith("<?"), "declaration").when(t.startswith("</"), "close").otherwise("open")
    name = F.when(kind.isin("open", "close"), F.lower(F.regexp_extract(t, rf"^</?({NAME})", 1))).when(~F.col("hit"), "#text").when(F.lower(t).startswith("<!doctype"), "#documentType")
    # what is shuffled of a page: its tags' texts, and of everything else only the length
    slim = each.where("t != ''").select(*keep, "_row", "place", length(t).alias("n"), kind.alias("kind"), name.alias("name"), F.when(kind == "open", t).alias("t"))
    slim = dealt(pages, slim, html, "_row")
    upto = F.sum("n").over(Window.partitionBy("_row").orderBy("place"))
    return slim.select(*keep, "_row", "place", (upto - F.col("n")).alias("start"), upto.alias("end"), "kind", "name", "t")


def split_raw(x: Column) -> Column:
    """A raw element's start tag and its text; other tokens as they are."""
    raw = x["hit"] & F.lower(F.regexp_extract(x["t"], rf"^<({NAME})", 1)).isin(*RAW)
    tag = F.regexp_extract(x["t"], START_TAG, 0)
    rest = F.substring(x["t"], F.length(tag) + 1, F.length(x["t"]))
    return F.when(raw, F.array(F.struct(tag.alias("t"), F.lit(True).alias("hit")), F.struct(rest.alias("t"), F.lit(False).alias("hit")))).otherwise(F.array(x))


def matched(tokens: DataFrame) -> DataFrame:
    """Opening tags with start, end (of the whole element), tag_end and name.

    An end tag ends the latest open element of its name; one that has none is passed over. Void elements are their tag. An element without an end tag ends at the end tag of
    the nearest element around it that has one, or with the text; those of SIBLING_ENDS at the latest where the next of their name begins there.
    """
    whole = F.max("end").over(Window.partitionBy("_row"))
    tags = tokens.withColumn("_last", whole).where("kind in ('open', 'close')").where(~F.col("name").isin(*VOID) | (F.col("kind") == "open"))
    void = F.col("name").isin(*VOID)
    own = Window.partitionBy("_row", "name").orderBy("place")
    step = F.when(void, 0).when(F.col("kind") == "open", 1).otherwise(-1)
    run = F.sum(step).over(own)
    tags = tags.withColumn("_run", run).withColumn("_low", F.least(F.min("_run").over(own), F.lit(0)))
    tags = tags.withColumn("_depth", F.col("_run") - F.col("_low"))
    # the depth of the element itself: after an opening tag, before a closing one; a stray end tag leaves the low mark lower
    stray = (F.col("kind") == "close") & (F.col("_run") == F.col("_low")) & (F.coalesce(F.lag("_low").over(own), F.lit(0)) > F.col("_low"))
    tags = tags.withColumn("_stray", stray).where("not _stray")
    tags = tags.withColumn("_level", F.col("_depth") + (F.col("kind") == "close").cast("int"))
    pair = Window.partitionBy("_row", "name", "_level").orderBy("place")
    closed = (F.col("kind") == "open") & ~void & (F.lead("kind").over(pair) == "close")
    tags = tags.withColumn("_closed", F.coalesce(closed, F.lit(False))).withColumn("_close_end", F.lead("end").over(pair))
    # how many closed elements are around a tag, over all names
    weight = F.when(F.col("_closed"), 1).when(F.col("kind") == "close", -1).otherwise(0)
    page = Window.partitionBy("_row").orderBy("place")
    tags = tags.withColumn("_around", F.sum(weight).over(page) - F.when(F.col("_closed"), 1).otherwise(0) + F.when(F.col("kind") == "close", 1).otherwise(0))
    later = Window.partitionBy("_row", "_around").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    tags = tags.withColumn("_outer", F.first(F.when(F.col("kind") == "close", F.col("start")), ignorenulls=True).over(later))
    next_own = F.first(F.when(F.col("kind") == "open", F.col("start")), ignorenulls=True).over(Window.partitionBy("_row", "_around", "name").orderBy("place").rowsBetween(1, Window.unboundedFollowing))
    tags = tags.withColumn("_sibling", F.when(F.col("name").isin(*SIBLING_ENDS), next_own))
    open_end = F.least(F.coalesce("_outer", "_last"), F.coalesce("_sibling", "_last"))
    end = F.when(void, F.col("end")).when(F.col("_closed"), F.col("_close_end")).otherwise(open_end)
    return tags.where("kind = 'open'").withColumn("tag_end", F.col("end")).withColumn("end", end)


def attributes(opened: DataFrame, keep: list[str]) -> DataFrame:
    """keep, start, end, name, html_binding of every attribute of opening tags (t, start): the first of each name."""
    head = F.regexp_extract("t", rf"^<{NAME}", 0)
    body = F.substring(F.col("t"), F.length(head) + 1, F.length("t") - F.length(head) - 1)
    each = opened.select(*keep, "_row", "place", F.col("start").alias("_from"), length(head).alias("_skip"), F.posexplode(pieces(body, ATTRIBUTE)).alias("k", "x"))
    upto = F.sum(length(F.col("x.t"))).over(Window.partitionBy("_row", "place").orderBy("k")) + F.col("_from") + F.col("_skip")
    found = each.withColumn("end", upto).where("x.hit").withColumn("start", F.col("end") - length(F.col("x.t"))).withColumn("name", F.lower(F.regexp_extract("x.t", ATTRIBUTE, 1)))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("_row", "place", "name").orderBy("k"))).where("_n = 1")
    return first.select(*keep, "start", "end", "name", F.col("name").isin(*HTML_BINDINGS).alias("html_binding"))


def template_anchors(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, start, end, kind (template_node, template_attribute), name, html_binding: elements, texts (#text) and the document type (#documentType) of templates, and their attributes.

    Null or empty pages have none. Rows that share an id are pages of their own. Comments have no anchors (see `markup.masked`).
    """
    tokens = lexed(pages, [id_col], F.col(html_col))
    opened = matched(tokens)
    none = F.lit(False)
    nodes = opened.select(id_col, "start", "end", F.lit("template_node").alias("kind"), "name", none.alias("html_binding"))
    others = tokens.where("name in ('#text', '#documentType')").select(id_col, "start", "end", F.lit("template_node").alias("kind"), "name", none.alias("html_binding"))
    attrs = attributes(opened, [id_col]).select(id_col, "start", "end", F.lit("template_attribute").alias("kind"), "name", "html_binding")
    return nodes.unionByName(others).unionByName(attrs)


def template_subjects(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, start, end, kind: each template that isn't empty is a subject as a whole."""
    return pages.where(F.length(html_col) > 0).select(id_col, F.lit(0).cast("long").alias("start"), F.length(html_col).cast("long").alias("end"), F.lit("template").alias("kind"))
