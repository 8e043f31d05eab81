"""Evidence in configuration: key paths of JSON and JSONC with spans, and the nodes of indented maps and lists, in DataFrame operations.

JSON is lexed by one alternation in which strings and comments can't hide in each other; depth is a running sum over brackets. A key's path is the last entry
at each lower depth, whose number of levels is that of the deepest text, 100 at most. YAML is read line by line: a node's parent is the nearest line
above with less indentation, so again the last one at each smaller depth. Windows are by text, whose tokens or lines are its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, dealt
from .elements import length, pieces

#: The deepest nesting, the longest key that is kept, and the reasons that are given.
MOST_DEPTH, KEY_CHARS = 100, 256
DEPTH_LIMIT, JSON_ERROR, YAML_ERROR = "depth_limit", "json_parse_error", "yaml_parse_error"

#: Strings are those of a text without_escapes(); so no string ends inside an escape.
JSON_TOKEN = r"(?s)\"[^\"]*\"|//[^\r\n]*|/\*.*?(?:\*/|\z)|[{}\[\],:]|[^\s{}\[\],:\"/]+"
MANIFEST = r"(?:^|/)(?:package\.json|[^/]*lock[^/]*)$"


#: What escapes are written as while a text is lexed: noncharacters, which no text has, for the backslash and for an escaped quote and backslash.
ESCAPE, QUOTE, BACKSLASH = "\ufdd0", "\ufdd1", "\ufdd2"


def without_escapes(json: Column) -> Column:
    """json with escape sequences as two other characters, neither a quote: lengths and offsets stay, and with_escapes() gives back what was there. A line's end isn't escaped."""
    marked = F.regexp_replace(json, r"\\([^\r\n])", ESCAPE + "$1")
    return F.replace(F.replace(marked, F.lit(ESCAPE + '"'), F.lit(ESCAPE + QUOTE)), F.lit(ESCAPE + "\\"), F.lit(ESCAPE + BACKSLASH))


def with_escapes(json: Column) -> Column:
    return F.translate(json, ESCAPE + QUOTE + BACKSLASH, '\\"\\')


def json_masked(json: Column) -> Column:
    """json with its comments as spaces; offsets stay. Comment signs in strings are no comments."""
    parts = F.transform(pieces(without_escapes(json), JSON_TOKEN), lambda x: F.when(x["hit"] & x["t"].startswith("/"), T.mask(x["t"])).otherwise(x["t"]))
    return F.when(F.contains(json, F.lit("/")), with_escapes(F.array_join(parts, ""))).otherwise(json)


def json_tokens(texts: DataFrame) -> DataFrame:
    """_row, place, start, end, t, kind (string, open, close, comma, colon, scalar) and depth (of a bracket, that inside it) of every token but comments of texts (_row, _json, whose escapes are written as
    without_escapes() does). Texts are shuffled, not their tokens."""
    each = dealt(texts, texts, F.col("_json"), "_row").select("_row", F.posexplode(pieces(F.col("_json"), JSON_TOKEN)).alias("place", "x")).select("_row", "place", "x.*")
    by = Window.partitionBy("_row").orderBy("place")
    t = F.col("t")
    kind = F.when(t.startswith('"'), "string").when(t.isin("{", "["), "open").when(t.isin("}", "]"), "close").when(t == ",", "comma").when(t == ":", "colon").when(t.startswith("/"), "comment").otherwise("scalar")
    each = each.withColumn("end", F.sum(length(t)).over(by)).where("hit").withColumn("start", F.col("end") - length(t)).withColumn("kind", kind)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    return each.where("kind != 'comment'").withColumn("depth", (F.sum(step).over(by) + F.when(F.col("kind") == "close", 1).otherwise(0)).cast("int")).drop("hit")


def json_properties(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, start, end, key, path, value_start of every property of JSON or JSONC texts: key (as written, the first KEY_CHARS) and path (the keys and places, such as [2], of what is around it, and
    itself) with the span from the key's start to the value's end.

    Broken texts have the properties that can be read; see `json_reasons`. Texts nested more deeply than MOST_DEPTH have none, null and empty ones neither. Rows that share an id are texts of their own.
    """
    lexed = without_escapes(F.coalesce(F.col(json_col), F.lit("")))
    texts = rows.select(F.col(id_col).alias("_id"), lexed.alias("_json")).withColumn("_row", F.monotonically_increasing_id())
    brackets = F.filter(F.regexp_extract_all("_json", F.lit(JSON_TOKEN), F.lit(0)), lambda x: x.isin("{", "[", "}", "]"))
    deep = F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper)["most"]
    texts = cut(texts.withColumn("_deep", deep).where(F.col("_deep").between(1, MOST_DEPTH)))
    deepest = texts.agg(F.max("_deep")).first()[0] or 0
    by, level = Window.partitionBy("_row").orderBy("place"), Window.partitionBy("_row", "depth").orderBy("place")
    tokens = json_tokens(texts.select("_row", "_json")).where(F.col("depth") > 0)
    is_key = (F.col("kind") == "string") & (F.lead("kind").over(by) == "colon")
    value_kind = F.lead("kind", 2).over(by)
    tokens = tokens.withColumn("_key", F.coalesce(is_key, F.lit(False))).withColumn("value_start", F.lead("start", 2).over(by)).withColumn("_value_kind", value_kind).withColumn("_colon_end", F.lead("end", 1).over(by))
    # the kind of container that a depth is in: that of its last opening bracket; an array's entry is its number of commas
    opens = F.col("kind") == "open"
    tokens = tokens.withColumn("_commas", F.sum((F.col("kind") == "comma").cast("int")).over(level))
    last_open = F.last(F.when(opens, F.struct(F.col("place").alias("place"), (F.col("t") == "[").alias("array"), F.col("_commas").alias("commas"))), ignorenulls=True).over(level)
    tokens = tokens.withColumn("_in", last_open).withColumn("_container", F.col("_in.place"))
    own = with_escapes(F.substring(F.col("t"), F.lit(2), F.length("t") - 2))
    nth = (F.col("_commas") - F.col("_in.commas")).cast("string")
    entry = F.when(F.col("_key"), F.left(own, F.lit(KEY_CHARS))).when(F.col("_in.array") & F.col("kind").isin("open", "comma"), F.concat(F.lit("["), nth, F.lit("]")))
    # where a value ends: a scalar or string with itself, a bracket with that which closes it, or with the text
    closes = F.max(F.when(F.col("kind") == "close", F.col("end"))).over(Window.partitionBy("_row", "depth", "_container"))
    tokens = tokens.select("_row", "place", "start", "kind", "depth", "_key", "value_start", "_value_kind", "_colon_end", entry.alias("_entry"), F.when(opens, closes).otherwise(F.col("end")).alias("_ends"))
    tokens = tokens.withColumn("_value_end", F.lead("_ends", 2).over(by))
    around = [F.last(F.when(F.col("depth") == d, F.col("_entry")), ignorenulls=True).over(by) for d in range(1, deepest)]
    levels = F.array(*around) if around else F.array().cast("array<string>")
    keys = tokens.withColumn("_levels", levels).where("_key")
    path = F.array_append(F.slice("_levels", F.lit(1), F.col("depth") - 1), F.col("_entry"))
    keys = keys.select("_row", "start", "_entry", path.alias("path"), "value_start", "_value_kind", "_value_end", "_colon_end")
    # ids come back at the end: no token carries them
    keys = keys.join(texts.select("_row", "_id", F.length("_json").cast("long").alias("_length")), "_row")
    has = F.coalesce(F.col("_value_kind").isin("string", "scalar", "open"), F.lit(False))
    end = F.when(has, F.coalesce("_value_end", "_length")).otherwise(F.col("_colon_end")).cast("long")
    return keys.select(F.col("_id").alias(id_col), "start", end.alias("end"), F.col("_entry").alias("key"), "path", F.when(has, F.col("value_start")).alias("value_start"))


def json_reasons(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, reason of texts that can't be read as JSON once their comments are masked (repeated keys, too, and empty texts), or that are nested too deeply."""
    clean = json_masked(F.col(json_col))
    depth = json_depth(clean)
    reason = F.when(depth > MOST_DEPTH, DEPTH_LIMIT).when(F.try_parse_json(clean).isNull(), JSON_ERROR)
    return rows.where(F.col(json_col).isNotNull()).select(id_col, reason.alias("reason")).where("reason is not null")


def json_depth(json: Column) -> Column:
    """The deepest nesting of a JSON text's brackets, those in strings aside."""
    brackets = F.regexp_replace(without_escapes(json), r"\"[^\"]*\"|[^{}\[\]\"]+", "")
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper)["most"]


def deeper(done: Column, x: Column) -> Column:
    now = done["now"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
    return F.struct(now.alias("now"), F.greatest(done["most"], now).alias("most"))

#: A line of a map or list: indentation, dashes, a key, what parts it from its value, a value in quotes or plain, spaces, a comment. Other lines can't be read.
YAML_PLAIN = r"(?:[^\s\"'\[\]{}#&*!|>%@`,?:-]|[-?:](?=[^\s]))(?:[^\s#:]++|(?<=\S)#|:(?=\S)| ++(?=[^\s#]))*+"
YAML_QUOTED = r"\"(?:[^\"\\]++|\\.)*+\"|'(?:[^']++|'')*+'"
YAML_KEY = rf"{YAML_QUOTED}|{YAML_PLAIN}"
YAML_VALUE = rf"{YAML_QUOTED}|{YAML_PLAIN}"
YAML_LINE = rf"^( *)((?:-(?: +|(?=\r?$)))*)(?:({YAML_KEY})( *):(?=[ \r]|$))?( *)({YAML_VALUE})?( *)((?<![^ ])#[^\r]*)?\r?$"
#: Columns beyond this one are too deep, and longer lines too long to be read.
MOST_COLUMN, MOST_LINE = 200, 8000


def yaml_masked(yaml: Column) -> Column:
    """yaml with its comments as spaces; offsets stay. Lines that can't be read stay as they are."""
    comment = lambda line: F.regexp_extract(line, YAML_LINE, 8)

    def masked_line(line: Column) -> Column:
        end = F.when(line.endswith("\r"), F.lit("\r")).otherwise(F.lit(""))
        n = F.length(comment(line))
        kept = F.substring(line, F.lit(1), F.length(line) - n - F.length(end))
        return F.when(n > 0, F.concat(kept, F.repeat(F.lit(" "), n), end)).otherwise(line)

    return F.array_join(F.transform(F.split(yaml, "\n", -1), masked_line), "\n")


def yaml_entries(rows: DataFrame, keep: list[str], yaml: Column) -> DataFrame:
    """keep, _row, _at (line and place), level (twice the column, one more for a list's item), item, key and value spans, bad: a row for every dash and key of a text's lines, and for scalars alone."""
    texts = rows.select(*keep, F.coalesce(yaml, F.lit("")).alias("_yaml")).withColumn("_row", F.monotonically_increasing_id())
    texts = dealt(rows, texts, yaml, "_row")
    each = texts.select(*keep, "_row", F.posexplode(F.split("_yaml", "\n", -1)).alias("line", "t"))
    own = Window.partitionBy("_row").orderBy("line")
    each = each.withColumn("_from", F.sum(F.length("t").cast("long") + 1).over(own) - F.length("t") - 1)
    marker = F.col("t").rlike(r"^---\s*$")
    seen = F.coalesce(F.sum((~F.col("t").rlike(r"^\s*(#.*)?$")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_skip", F.col("t").rlike(r"^\s*(#.*)?$") | (marker & (seen == 0)))
    # the line's parts by one match; a line that doesn't fit stays whole
    parts = F.split(F.regexp_replace("t", YAML_LINE, "$1\x01$2\x01$3\x01$4\x01$5\x01$6"), "\x01", -1)
    each = each.where("not _skip").withColumn("_parts", F.when((F.length("t") <= MOST_LINE) & ~F.contains("t", F.lit("\x01")), parts))
    fits = F.coalesce(F.size("_parts") == 6, F.lit(False))
    each = each.withColumn("bad", ~fits | F.when(fits, F.length(F.col("_parts")[0]) + F.length(F.col("_parts")[1]) > MOST_COLUMN).otherwise(False))
    names = ["indent", "dashes", "name", "gap", "space", "value"]
    each = each.select("*", *[F.when(~F.col("bad"), F.col("_parts")[i]).otherwise("").alias(n) for i, n in enumerate(names)]).drop("_parts")
    body = F.length("indent") + F.length("dashes")
    has_key = F.col("name") != ""
    value_at = body + F.when(has_key, F.length("name") + F.length("gap") + 1).otherwise(0) + F.length("space")
    # the columns of a line's dashes
    columns = F.filter(F.transform(F.split("dashes", ""), lambda c, i: F.when(c == "-", i + F.length("indent"))), lambda c: c.isNotNull())
    entry = lambda column, item, name, value: F.struct(column.cast("int").alias("column"), F.lit(item).alias("item"), name.alias("named"), value.alias("valued"))
    last = F.size(columns) - 1
    scalar = (F.col("value") != "") & ~has_key
    items = F.transform(columns, lambda c, i: entry(c, True, F.lit(False), scalar & (i == last)))
    keys = F.when(has_key, F.array(entry(body, False, F.lit(True), F.col("value") != ""))).when(scalar & (F.size(columns) == 0), F.array(entry(body, False, F.lit(False), F.lit(True))))
    listed = F.when(F.col("bad"), F.array(entry(F.lit(0), False, F.lit(False), F.lit(False)))).otherwise(F.concat(items, F.coalesce(keys, F.array().cast("array<struct<column:int,item:boolean,named:boolean,valued:boolean>>"))))
    out = each.select(*keep, "_row", "line", "_from", "bad", body.alias("_body"), value_at.alias("_value_at"), "name", "value", F.posexplode(listed).alias("k", "e"))
    span = lambda cond, at, n: (F.when(cond, F.col("_from") + at), F.when(cond, F.col("_from") + at + n))
    key_start, key_end = span(F.col("e.named"), F.col("_body"), F.length("name"))
    value_start, value_end = span(F.col("e.valued"), F.col("_value_at"), F.length("value"))
    level = 2 * F.col("e.column") + F.col("e.item").cast("int")
    at = F.col("line").cast("long") * (MOST_COLUMN + 1) + F.col("k")
    return out.select(*keep, "_row", at.alias("_at"), level.alias("level"), F.col("e.item").alias("item"), "bad", (F.col("_from") + F.col("e.column")).alias("start"), key_start.alias("key_start"), key_end.alias("key_end"), value_start.alias("value_start"), value_end.alias("value_end"), "name")


def yaml_placed(entries: DataFrame) -> DataFrame:
    """entries with parent (_at; null at the top) and wrong: the nearest entry above with less indentation, and whether a text can be read whole: its lines are known, entries of one parent are all
    keys or all items in one column, keys differ, and nothing has both a scalar and entries."""
    by = Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r[0] for r in entries.select("level").distinct().collect())  # at most twice MOST_COLUMN
    above = [F.last(F.when(F.col("level") == n, F.col("_at")), ignorenulls=True).over(by).alias(f"_l{n}") for n in levels]
    held = entries.select("*", *above)
    parent = F.lit(None).cast("long")
    if levels:
        parent = F.array_max(F.array(*[F.when(F.col("level") > n, F.col(f"_l{n}")) for n in levels]))
    held = held.withColumn("parent", parent).drop(*[f"_l{n}" for n in levels])
    siblings = Window.partitionBy("_row", "parent")
    mixed = (F.min("level").over(siblings) != F.max("level").over(siblings)) | (~F.col("item") & F.col("key_start").isNull() & (F.count(F.lit(1)).over(siblings) > 1))
    named = F.when(F.col("key_start").isNotNull(), F.regexp_replace("name", r"^[\"']|[\"']$", ""))
    twice = named.isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy("_row", "parent", named)) > 1)
    # an entry is before its children, so a child that follows at once has it as parent
    own_scalar = F.last(F.when(F.col("value_start").isNotNull(), F.col("_at")), ignorenulls=True).over(by)
    both = F.coalesce(own_scalar == F.col("parent"), F.lit(False))
    wrong = F.max((F.col("bad") | mixed | twice | both).cast("int")).over(Window.partitionBy("_row")) == 1
    return held.withColumn("wrong", wrong)


def yaml_nodes(rows: DataFrame, id_col: str, yaml_col: str) -> DataFrame:
    """id, start, end, container of the nodes of YAML texts made of block maps, block lists, plain and quoted scalars of a line, and comments: map and sequence from their first entry to the end of the last value in them,
    scalar for keys and values.

    Texts with anything else (flow collections, anchors, aliases, tags, block scalars, several documents, tabs), with repeated keys or uneven indentation have no nodes, see `yaml_reasons`; so null and empty ones. Rows that share an id are texts
    of their own.
    """
    good = cut(yaml_placed(yaml_entries(rows, [id_col], F.col(yaml_col))).where("not wrong"))
    scalars = good.select(id_col, F.explode(F.array(F.struct(F.col("key_start").alias("start"), F.col("key_end").alias("end")), F.struct(F.col("value_start").alias("start"), F.col("value_end").alias("end")))).alias("s"))
    scalars = scalars.select(id_col, "s.start", "s.end", F.lit("scalar").alias("container")).where("start is not null")
    # a collection ends with the last thing before the next entry that is less indented
    by = Window.partitionBy("_row").orderBy("_at")
    own_end = F.greatest(F.coalesce("value_end", F.lit(-1)), F.coalesce(F.col("key_end") + 1, F.lit(-1)), F.when(F.col("item"), F.col("start") + 1).otherwise(-1))
    ended = dealt(rows, good, F.col(yaml_col), "_row").withColumn("_end", own_end).withColumn("_before", F.lag("_end").over(by)).withColumn("_last", F.last("_end").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    levels = sorted(r[0] for r in good.select("level").distinct().collect())
    after = by.rowsBetween(1, Window.unboundedFollowing)
    stop = F.lit(None).cast("long")
    for n in levels:
        stop = F.when(F.col("level") == n, F.first(F.when(F.col("level") < n, F.col("_before")), ignorenulls=True).over(after)).otherwise(stop)
    heads = ended.withColumn("_stop", stop).withColumn("_n", F.row_number().over(Window.partitionBy("_row", "parent").orderBy("_at"))).where("_n = 1 and (item or key_start is not null)")
    return scalars.unionByName(heads.select(id_col, "start", F.coalesce("_stop", "_last").alias("end"), F.when(F.col("item"), "sequence").otherwise("map").alias("container")))


def yaml_reasons(rows: DataFrame, id_col: str, yaml_col: str) -> DataFrame:
    """id, reason of the YAML texts that `yaml_nodes` can't read."""
    wrong = yaml_placed(yaml_entries(rows, [id_col], F.col(yaml_col))).where("wrong").select(id_col, "_row").distinct()
    return wrong.select(id_col, F.lit(YAML_ERROR).alias("reason"))


def configuration_subjects(rows: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, start, end, kind: a file that isn't empty is a subject as a whole, a dependency manifest by its name or a configuration."""
    kind = F.when(F.col(path_col).rlike(MANIFEST), "dependency_manifest").otherwise("configuration")
    return rows.where(F.length(text_col) > 0).select(path_col, F.lit(0).cast("long").alias("start"), F.length(text_col).cast("long").alias("end"), kind.alias("kind"))


def resources(rows: DataFrame, id_col: str, json_col: str, most_depth: int = 20, most_facts: int = 200) -> DataFrame:
    """id, place, depth, type, name, identity_type, reason of the resources that JSON texts declare: those of the member `resources`, and those that each has in its own, down to most_depth, in order of the text.

    A text's facts beyond most_facts aren't given: its last row then has no place and the reason resource_budget, as where it goes deeper. Elements that aren't objects are passed over. Descent is one
    explode a level, and stops where no text goes deeper.
    """
    text = F.coalesce(F.try_parse_json(json_col), F.parse_json(F.lit("null")))
    level = rows.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.try_variant_get(text, "$.resources", "array<variant>").alias("_list"))
    level = cut(level.select(id_col, "_row", F.array().cast("array<int>").alias("_at"), "_list").where("size(_list) > 0"))
    found = None
    for depth in range(most_depth + 2):
        each = level.select(id_col, "_row", "_at", F.posexplode("_list").alias("k", "v")).withColumn("_at", F.array_append("_at", F.col("k")))
        each = each.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
        get = lambda p: F.try_variant_get(F.col("v"), p, "string")
        level = cut(each.select(id_col, "_row", "_at", F.lit(depth).alias("depth"), get("$.type").alias("type"), get("$.name").alias("name"), get("$.identity.type").alias("identity_type"), F.try_variant_get(F.col("v"), "$.resources", "array<variant>").alias("_list")))
        part = level.drop("_list")
        found = part if found is None else found.unionByName(part)
        level = level.where("size(_list) > 0").select(id_col, "_row", "_at", "_list")
        if level.isEmpty():
            break
    order = Window.partitionBy("_row").orderBy("_at")
    placed = found.withColumn("place", F.row_number().over(order))
    over = (F.col("place") > most_facts) | (F.col("depth") > most_depth)
    facts = placed.where(~over).select(id_col, "place", "depth", "type", "name", "identity_type", F.lit(None).cast("string").alias("reason"))
    cut_off = placed.where(over).select(id_col, "_row").distinct().select(id_col, *[F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("depth", "int"), ("type", "string"), ("name", "string"), ("identity_type", "string"))], F.lit("resource_budget").alias("reason"))
    return facts.unionByName(cut_off)
