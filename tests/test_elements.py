"""Template anchors against a plain parser that goes character by character."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import elements, markup
from lodestone.session import table

SPACE = " \t\n\r\f\v"


def plain_tokens(s):
    """(kind, start, end, name, attributes) by a state machine."""
    out, i, n, text = [], 0, len(s), 0

    def flush(to):
        if to > text:
            out.append(("text", text, to, None, []))

    while i < n:
        if s[i] != "<":
            i += 1
            continue
        if s.startswith("<!--", i):
            end = s.find("-->", i + 4)
            end = n if end < 0 else end + 3
            flush(i)
            out.append(("comment", i, end, None, []))
            i = text = end
            continue
        if s[i + 1 : i + 2] in ("!", "?") and ">" in s[i:]:
            end = s.index(">", i) + 1
            flush(i)
            out.append(("declaration", i, end, s[i:end], []))
            i = text = end
            continue
        close = s[i + 1 : i + 2] == "/"
        j = i + 1 + close
        if j >= n or not (s[j].isascii() and s[j].isalpha()):
            i += 1
            continue
        k = j
        while k < n and s[k] not in SPACE + "/>":
            k += 1
        name, attrs, ended = s[j:k].lower(), [], False
        while k < n:
            if s[k] == ">":
                ended = True
                break
            if s[k] in SPACE + "/\"'<=":
                k += 1
                continue
            a = k
            while k < n and s[k] not in SPACE + "\"'<>/=":
                k += 1
            label, b = s[a:k].lower(), k
            e = k
            while e < n and s[e] in SPACE:
                e += 1
            if e < n and s[e] == "=":
                e += 1
                while e < n and s[e] in SPACE:
                    e += 1
                if e < n and s[e] in "\"'" and s.find(s[e], e + 1) >= 0:
                    b = s.index(s[e], e + 1) + 1
                elif e < n and s[e] not in "\"'=<>`":
                    while e < n and s[e] not in SPACE + "\"'=<>`":
                        e += 1
                    b = e
            attrs.append((label, a, b))
            k = b
        if not ended:
            i += 1
            continue
        flush(i)
        out.append(("close" if close else "open", i, k + 1, name, attrs))
        i = text = k + 1
        if not close and name in elements.RAW:
            low, e = s.lower(), i
            while True:
                e = low.find(f"</{name}", e)
                if e < 0:
                    e = n
                    break
                if e + 2 + len(name) < n and low[e + 2 + len(name)] in SPACE + "/>":
                    break
                e += 1
            i = text if e == i else e
    flush(n)
    return out


def plain(s):
    """Anchors as the docstrings state them, by one list of open elements."""
    found, stack, tokens = [], [], plain_tokens(s)
    opens = []  # [name, start, tag_end, end or None, place]
    for place, (kind, a, b, name, attrs) in enumerate(tokens):
        if kind == "text" or (kind == "declaration" and name.lower().startswith("<!doctype")):
            found.append((a, b, "template_node", "#text" if kind == "text" else "#documentType", False))
        elif kind == "open":
            seen = set()
            for label, x, y in attrs:
                if label not in seen:
                    seen.add(label)
                    found.append((x, y, "template_attribute", label, label in ("[innerhtml]", "v-html")))
            e = [name, a, b, b if name in elements.VOID else None, place, None]
            opens.append(e)
            if name not in elements.VOID:
                stack.append(e)
        elif kind == "close" and name not in elements.VOID:
            for e in reversed(stack):
                if e[0] == name and e[3] is None:
                    e[3], e[5] = b, (place, a)
                    break
    pairs = [e for e in opens if e[5]]
    around = lambda place: [e for e in pairs if e[4] < place < e[5][0]]
    for e in opens:
        if e[3] is None:
            outside = around(e[4])
            level = len(outside)
            later = [p for p in pairs if p[5][0] > e[4] and len([q for q in pairs if q[4] < p[5][0] and q[5][0] >= p[5][0]]) == level]
            end = min((p[5] for p in later), default=(None, len(s)))[1]
            if e[0] in elements.SIBLING_ENDS:
                end = min([end] + [o[1] for o in opens if o[0] == e[0] and o[4] > e[4] and len(around(o[4])) == level][:1])
            e[3] = end
        found.append((e[1], e[3], "template_node", e[0], False))
    return sorted(found)


PAGES = [
    "",
    "plain text",
    "<!-- private hint --><p>{{ value }}</p><div [innerHTML]=\"value\"></div>",
    "<!DOCTYPE html><html><head><title>a <b> c</title><script>if (a<b) \"<i>\" // </scriptx> </script></head><body class=x>t</body></html>",
    "<div a=\"x > y\" b='<p>' c=it's d = 5>in</div>after",
    "<ul><li>a<ul><li>x<li>y</ul><li>b</ul><p>one<p>two<br>three",
    "<p><b>bold<br><p>second</p></b></p></i>",
    "<x><div><x></div></x> < 5 <3 <!-- open",
    "<IMG src=a.png/><input v-html=z V-HTML=w disabled><br/>",
    "<textarea><div></textarea><style>p{}</style><style>",
    "<a href=\"unclosed>text<p>more</p>",
    "<p\nclass = \"x\ny\"\t>ü😀<i>é</i></p>",
    "<svg><path d='M0'/></svg><custom-el @click=\"go\" :x='1'></custom-el>",
]


def anchors(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string").repartition(3)
    got = {i: [] for i in range(len(pages))}
    for r in elements.template_anchors(df, "id", "html").collect():
        got[r.id].append((r.start, r.end, r.kind, r.name, r.html_binding))
    return {i: sorted(v) for i, v in got.items()}


def test_anchors_equal_a_plain_parser(spark):
    got = anchors(spark, PAGES)
    for i, page in enumerate(PAGES):
        assert got[i] == plain(page), page


def test_anchors_of_random_markup(spark):
    r = random.Random(3)
    bits = ["<div>", "</div>", "<p>", "</p>", "<b x=1>", "</b>", "<br>", "text ", "<li>", "</li>", "<ul>", "</ul>", "<!-- c -->", "<script>", "</script>", "<i title=\"a>b\">", "</i>", "é", "<"]
    pages = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(150)]
    got = anchors(spark, pages)
    for i, page in enumerate(pages):
        assert got[i] == plain(page), page


def test_anchors_of_the_pages(spark, sf):
    pages = [r[0] for r in table(spark, sf, "pages").select("html").collect()]
    got = anchors(spark, pages)
    for i, page in enumerate(pages):
        assert got[i] == plain(page)


def test_null_pages_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "<p>a"), (1, "<p>a"), (None, "<p>a")], "id long, html string")
    got = sorted(((r.id, r.start, r.end, r.name) for r in elements.template_anchors(df, "id", "html").collect()), key=str)
    one = [(0, 4, "p"), (3, 4, "#text")]
    assert got == sorted([(i, *x) for i in (1, 1, None) for x in one], key=str)
    assert elements.template_subjects(df, "id", "html").count() == 3


def test_sanitized_text_keeps_offsets(spark):
    page = PAGES[2]
    df = spark.createDataFrame([(1, page)], "id long, html string")
    clean = df.select(markup.masked(F.col("html")).alias("m")).first().m
    assert len(clean) == len(page) and "private" not in clean
    bindings = elements.template_anchors(df, "id", "html").where("html_binding").collect()
    assert [page[b.start : b.end] for b in bindings] == ['[innerHTML]="value"']


@pytest.mark.parametrize("n", [3000])
def test_long_pages(spark, n):
    page = "<div>" * n + "x" + "</div>" * n
    got = anchors(spark, [page])[0]
    assert len(got) == n + 1 and got[0][:2] == (0, len(page))


def test_pages_are_dealt_by_their_length(spark, monkeypatch):
    monkeypatch.setattr("lodestone.session.TASK_CHARS", 50)
    n = 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = spark.createDataFrame([(i, "<b>xyz</b>") for i in range(5 * n)], "id int, t string")
    tokens = elements.lexed(pages, ["id"], F.col("t"))
    assert tokens.rdd.getNumPartitions() == n and tokens.count() == 15 * n
