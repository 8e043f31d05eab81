"""Evidence in markup and JSON: comments masked, elements and links as anchors and relationships, facts of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import directory, normalized
from .elements import lexed

COMMENT = ("<!--", "<!--.*?-->")


def masked(html: Column) -> Column:
    """html with its comments as spaces; offsets stay."""
    return T.mask_matches(html, *COMMENT)


def anchors(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, start, end, tag of every opening tag, quotes and raw texts understood: no Python, whole texts, linear in a page."""
    opened = lexed(pages, [id_col], F.col(html_col)).where("kind = 'open'")
    return opened.select(id_col, "start", "end", F.col("name").alias("tag"))


def links(pages: DataFrame, id_col: str, html_col: str, path_col: str) -> DataFrame:
    """id, target: the href values outside comments, relative ones resolved against the page's path."""
    hrefs = F.regexp_extract_all(masked(F.col(html_col)), F.lit(r"(?i)\shref=\"([^\"]*)\""), F.lit(1))
    each = pages.select(id_col, path_col, F.explode(hrefs).alias("href"))
    relative = F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(directory(F.col(path_col)), F.lit("/"), F.col("href")))
    return each.select(id_col, F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).otherwise(normalized(relative)).alias("target"))


def json_facts(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, name, value of the members of JSON objects, as text; other JSON has none."""
    return rows.select(id_col, F.explode(F.from_json(json_col, "map<string,string>")).alias("name", "value"))
