"""Configuration evidence against plain parsers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import configuration as C


def plain_properties(s):
    """(start, end, key, path, value_start) of a JSON text by recursive descent."""
    out = []

    def space(i):
        while i < len(s):
            if s[i].isspace():
                i += 1
            elif s.startswith("//", i):
                while i < len(s) and s[i] not in "\r\n":
                    i += 1
            elif s.startswith("/*", i):
                i = s.index("*/", i) + 2
            else:
                break
        return i

    def string(i):
        j = i + 1
        while s[j] != '"':
            j += 2 if s[j] == "\\" else 1
        return j + 1

    def value(i, path):
        i = space(i)
        if s[i] == '"':
            return string(i)
        if s[i] in "{[":
            close, is_array, k = "}]"[s[i] == "["], s[i] == "[", 0
            i = space(i + 1)
            while s[i] != close:
                if is_array:
                    i = space(value(i, [*path, f"[{k}]"]))
                else:
                    begin = i
                    i = string(i)
                    key = s[begin + 1 : i - 1][:256]
                    i = space(i)
                    assert s[i] == ":"
                    at = space(i + 1)
                    i = value(at, [*path, key])
                    out.append((begin, i, key, [*path, key], at))
                    i = space(i)
                if s[i] == ",":
                    i, k = space(i + 1), k + 1
            return i + 1
        while i < len(s) and s[i] not in ",]} \t\r\n/":
            i += 1
        return i

    if s.strip():
        value(0, [])
    return sorted(out)


def some(r, depth=0):
    kind = r.choice(["object", "object", "array", "array", "scalar"]) if depth < 5 else "scalar"
    if kind == "object":
        return {r.choice(["a", "b", "k\n", 'q"', "// no", "é😀", "x\\"]) + str(i): some(r, depth + 1) for i in range(r.randint(0, 4))}
    if kind == "array":
        return [some(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([1, -2.5, True, None, "", "text", 'quo"te', "/* no */", "{[,:]}", "back\\"])


def with_comments(r, text):
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            inside = not inside
        out.append(c)
        if not inside and c in "{,[" and r.random() < 0.3:
            out.append(r.choice(["/* c: {\" */", "// \"x\": 1\n", "// c \\\n", "\n  "]))
        i += 1
    return "".join(out)


def texts():
    r = random.Random(11)
    out = ["", "{}", "[]", "5", '{"a": {"b": [1, {"c": "x"}], "d": {}}, "e": []}', '{"a" /* k */ : // v\n 1}']
    for _ in range(120):
        t = json.dumps(some(r), indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)
        out.append(with_comments(r, t) if r.random() < 0.6 else t)
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string").repartition(3)


def test_properties_equal_a_plain_parser(spark):
    rows = texts()
    got = {i: [] for i in range(len(rows))}
    for x in C.json_properties(frame(spark, rows), "id", "t").collect():
        got[x.id].append((x.start, x.end, x.key, x.path, x.value_start))
    for i, t in enumerate(rows):
        assert sorted(got[i]) == plain_properties(t), t


def test_comments_are_masked(spark):
    rows = texts()
    for x in frame(spark, rows).select("t", C.json_masked(F.col("t")).alias("m")).collect():
        assert len(x.m) == len(x.t)
        assert all(a in (b, " ") for a, b in zip(x.m, x.t, strict=True))
        if x.t.strip():
            json.loads(x.m)  # nothing but JSON is left


def test_broken_deep_and_missing_texts(spark):
    deep = "[" * 101 + "]" * 101
    rows = ['{"value":', '{"a": 1, }', "", None, deep, "[" * 100 + "]" * 100, '{"a": 1, "b": {"c": 2', '{"ok": "[[[" }', '{"a": 1, "b": "' + "[" * 200 + '"}']
    reasons = {x.id: x.reason for x in C.json_reasons(frame(spark, rows), "id", "t").collect()}
    assert reasons == {0: "json_parse_error", 1: "json_parse_error", 2: "json_parse_error", 4: "depth_limit", 6: "json_parse_error"}
    got = {x.id: (x.start, x.end, x.key) for x in C.json_properties(frame(spark, rows), "id", "t").where("id in (0, 4, 7)").collect()}
    assert got == {0: (1, 9, "value"), 7: (1, 12, "ok")}
    subjects = spark.createDataFrame([("a/package.json", "{}"), ("yarn.lock", "x"), ("c.yml", "a: 1"), ("d.json", "")], "path string, t string")
    assert {x.path: (x.end, x.kind) for x in C.configuration_subjects(subjects, "path", "t").collect()} == {"a/package.json": (2, "dependency_manifest"), "yarn.lock": (1, "dependency_manifest"), "c.yml": (4, "configuration")}


def plain_resources(text, most_depth=20, most=200):
    try:
        value = json.loads(text)
    except (ValueError, TypeError):
        return [], False
    facts, over = [], False

    def visit(items, depth):
        nonlocal over
        for item in items:
            if not isinstance(item, dict):
                continue
            if depth > most_depth or len(facts) >= most:
                over = True
                return
            identity = item.get("identity")
            facts.append((depth, item.get("type"), item.get("name"), identity.get("type") if isinstance(identity, dict) else None))
            if isinstance(item.get("resources"), list):
                visit(item["resources"], depth + 1)

    if isinstance(value, dict) and isinstance(value.get("resources"), list):
        visit(value["resources"], 0)
    return facts, over


def nested(n):
    return {"type": "t", "name": f"n{n}", **({"resources": [nested(n - 1)]} if n else {})}


def test_resources_equal_descent(spark):
    rows = [
        json.dumps({"resources": [{"type": "a", "name": "x", "identity": {"type": "system"}, "resources": [{"type": "b"}, 5, None, {"name": "y", "resources": []}]}, "no", {"type": "c", "identity": "none", "resources": {}}]}),
        json.dumps({"resources": [nested(20)]}), json.dumps({"resources": [nested(21)]}), json.dumps({"resources": [{"type": str(i)} for i in range(200)]}),
        json.dumps({"resources": [{"type": str(i), "resources": [{"name": "in"}]} for i in range(150)]}), "{}", "not json", None, json.dumps({"resources": {"type": "a"}}),
    ]
    got = {i: ([], False) for i in range(len(rows))}
    for x in C.resources(frame(spark, rows), "id", "t").orderBy("id", F.col("place").asc_nulls_last()).collect():
        facts, _ = got[x.id]
        got[x.id] = (facts, True) if x.reason else ([*facts, (x.depth, x.type, x.name, x.identity_type)], False)
    for i, t in enumerate(rows):
        assert got[i] == plain_resources(t), t


@pytest.mark.parametrize("n", [4000])
def test_long_texts_are_linear(spark, n):
    text = json.dumps({f"k{i}": "v\\\"" * 3 for i in range(n)})
    assert C.json_properties(frame(spark, [text]), "id", "t").count() == n


def plain_yaml(text):
    """(start, end, container) by recursive descent over lines, None where a text can't be read. The plain scalars that the tests use are words."""
    import re

    entries, at, first = [], 0, True
    for line in text.split("\n"):
        body = line.rstrip("\r")
        code = re.sub(r"(^|(?<= ))#.*$", "", body) if "'" not in body and '"' not in body else body
        code = code.rstrip(" ")
        if code.strip() and not (code == "---" and first):
            first = False
            col = len(code) - len(code.lstrip(" "))
            items = []
            while code[col:] == "-" or code[col : col + 2] == "- ":
                items.append(col)
                col += 1
                while col < len(code) and code[col] == " ":
                    col += 1
            rest = code[col:]
            m = re.fullmatch(r"([\w.-]+|\"[^\"]*\"|'[^']*')( *):(?: +(.*))?", rest)
            key, value = (m[1], m[3]) if m else (None, rest or None)
            if value is not None and value != "" and not re.fullmatch(r"[\w./:-]+(?: +[\w./]+)*|\"[^\"]*\"|'[^']*'", value):
                return None
            for c in items:
                entries.append([2 * c + 1, at + c, None, None, None])
            if key:
                start = at + col + len(rest) - len(value) if value else None
                entries.append([2 * col, at + col, (at + col, at + col + len(key)), (start, start + len(value)) if value else None, key.strip("\"'")])
            elif value:
                if items:
                    entries[-1][3] = (at + col, at + col + len(value))
                else:
                    entries.append([2 * col, at + col, None, (at + col, at + col + len(value)), None])
        at += len(line) + 1
    out = []

    def end_of(e):
        return max(e[3][1] if e[3] else -1, e[2][1] + 1 if e[2] else -1, e[1] + 1 if e[0] % 2 else -1)

    def collection(i, above):
        """The entries from i on that are deeper than above; where they end."""
        level, names, begin, n = entries[i][0], set(), i, 0
        while i < len(entries) and entries[i][0] > above:
            e = entries[i]
            if e[0] != level or (e[4] is not None and e[4] in names):
                raise ValueError
            names.add(e[4])
            n += 1
            if e[2]:
                out.append((*e[2], "scalar"))
            if e[3]:
                out.append((*e[3], "scalar"))
            i += 1
            if i < len(entries) and entries[i][0] > level:
                if e[3]:
                    raise ValueError
                i = collection(i, level)
        alone = entries[begin][0] % 2 == 0 and entries[begin][2] is None
        if alone and n > 1 or any(x[0] == level and x[0] % 2 == 0 and x[2] is None for x in entries[begin:i]) and n > 1:
            raise ValueError
        if not alone:
            out.append((entries[begin][1], end_of(entries[i - 1]), "sequence" if level % 2 else "map"))
        return i

    try:
        if entries and collection(0, -1) != len(entries):
            return None
    except ValueError:
        return None
    return sorted(out)


YAML = [
    "limits:\n  attempts: 3 # hint\n",
    "a: 1\nb:\n- x\n- y: 2\n  z: 3\n- - p\n  - q\nc: 'it # no'\n",
    "---\n# top\nname: \"q: r\"\nurl: http://x/y\nlist:\n  - one\n  # between\n  - two # c\r\n  -\n    deep: yes\n",
    "plain scalar", "", "# only\n", "a:\n    b: 1\n  c: 2\n", "a: 1\na: 2\n", "a: [1, 2]\n", "a: &x 1\nb: *x\n", "a: |\n  text\n", "a: 1\n  b: 2\n", "- a\nb: 1\n", "\ta: 1\n", "a: 1\n---\nb: 2\n", "x\ny\n", "k: \n  - - - v\n", "a:\nb:\n",
]


def some_yaml(r):
    lines = []

    def put(indent, depth):
        kind = r.choice(["map", "list"])
        for i in range(r.randint(1, 3)):
            head = " " * indent + (f"k{i}:" if kind == "map" else "-")
            if depth < 3 and r.random() < 0.4:
                lines.append(head + r.choice(["", "  # note"]))
                put(indent + r.choice([2, 4]), depth + 1)
            else:
                lines.append(head + r.choice([" v", " two words", " 'q'", "", " 1.5 # c"]))
            if r.random() < 0.2:
                lines.append(r.choice(["", "# c: d", "      # far"]))

    put(0, 0)
    return "\n".join(lines) + r.choice(["", "\n"])


def test_yaml_equals_a_plain_parser(spark):
    r = random.Random(6)
    rows = YAML + [some_yaml(r) for _ in range(120)]
    df = frame(spark, rows)
    got = {i: [] for i in range(len(rows))}
    for x in C.yaml_nodes(df, "id", "t").collect():
        got[x.id].append((x.start, x.end, x.container))
    wrong = {x.id for x in C.yaml_reasons(df, "id", "t").collect()}
    for i, t in enumerate(rows):
        want = plain_yaml(t)
        assert (i in wrong) == (want is None), t
        assert sorted(got[i]) == (want or []), t
    assert sum(plain_yaml(t) is None for t in YAML) == 10


def test_yaml_comments_are_masked(spark):
    for x in frame(spark, YAML).select("t", C.yaml_masked(F.col("t")).alias("m")).collect():
        assert len(x.m) == len(x.t) and all(a in (b, " ") for a, b in zip(x.m, x.t, strict=True))
    clean = frame(spark, YAML[:3]).select("id", C.yaml_masked(F.col("t")).alias("m")).collect()
    assert {x.id: x.m for x in clean} == {0: "limits:\n  attempts: 3       \n", 1: YAML[1], 2: YAML[2].replace("# top", "     ").replace("# between", "         ").replace("# c", "   ")}


def test_texts_are_dealt_by_their_length(spark, monkeypatch):
    monkeypatch.setattr("lodestone.session.TASK_CHARS", 50)
    n = 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    yaml = spark.createDataFrame([(i, "a: 1\nbb: 2") for i in range(5 * n)], "id int, t string")
    assert C.yaml_entries(yaml, ["id"], F.col("t")).rdd.getNumPartitions() == -(-5 * n * 10 // 50) >= n
    texts = spark.createDataFrame([(i, '{"a": [1]}') for i in range(5 * n)], "_row long, _json string")
    tokens = C.json_tokens(texts)
    assert tokens.rdd.getNumPartitions() == n and "t" not in texts.columns and tokens.count() == 5 * n * 7
