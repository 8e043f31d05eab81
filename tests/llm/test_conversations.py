import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos string, fault string, h long, _tie long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "f", 1, 2) for r in rows], SCHEMA)


def damaged(rows):
    """Plain damage: conv -> rows in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return out


def plain(rows):
    """The cheapest repair by recursion over all edits: gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")

    def straight(i, state):
        """cost, audit and lines from here on, without an insert first; state: the last initial, or none."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(rows):
            _, role, text = rows[i]
            late = faults[i] == "truncated"
            c = full(i + 1, state)
            ways.append((3 + c[0], "D" + c[1], c[2]))
            if faults[i] in ("", "truncated"):
                if role[:1] and role[:1] in after:
                    c = full(i + 1, role[0])
                    ways.append((late + c[0], "K" + c[1], (f"{role}:{text}", *c[2])))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in after:
                        c = full(i + 1, x)
                        ways.append((2 + late + c[0], "R" + c[1], (f"{name}:{text}", *c[2])))
        return min(ways, default=(1 << 30, "", ()))

    @lru_cache(None)
    def full(i, state):
        """As straight, with up to three inserts first: more are never worth it."""
        ways, at, audit, lines = [straight(i, state)], state, "", ()
        for n in (1, 2, 3):
            at = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
            audit, lines = audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[at])
            c = straight(i, at)
            ways.append((2 * n + c[0], audit + c[1], (*lines, *c[2])))
        return min(ways)

    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    cost, audit, lines = full(0, "")
    assert legal.fullmatch("".join(x[0] for x in lines))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        at = 0
        for _ in range(r.choice([1, 2, 3, 6, 12])):
            at += r.choice([1, 1, 1, 2, 4])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, at, role, r.choice(["Yes.", "No!", "cut short", " ", "", None, "Well? ", "é. \t", "one. two"])))
    return rows


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 1), (3, 2)])
def test_repair_equals_trying_all_edits(spark, monkeypatch, seed, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = some(seed, 120)
    got = collected(C.damage_and_repair(frame(spark, rows).repartition(5)))
    want = {conv: plain(kept) for conv, kept in damaged(rows).items()}
    assert got == want


def test_blocks_of_one_long_conversation(spark, monkeypatch):
    """Blocks dealt over tasks make the same audit as the whole chain."""
    r = random.Random(4)
    rows = [(1, i, r.choice(["user", "assistant", "system"]), r.choice(["Yes %d." % i, "no %d" % i, "same."])) for i in range(3000)]
    whole = collected(C.damage_and_repair(frame(spark, rows)))
    monkeypatch.setattr(C, "BLOCK", 37)
    assert collected(C.damage_and_repair(frame(spark, rows).repartition(7))) == whole
    codes = bytes(r.choice(range(12)) for _ in range(300))
    dist = C.distances(codes, C.FINISH)
    m = [C.matrix(codes[i : i + 37]) for i in range(0, 300, 37)]
    last = C.FINISH
    for x in reversed(m):
        last = [min(x[q * 4 + e] + last[e] for e in range(4)) for q in range(4)]
    assert last == dist[:4]


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "word " * 400_000
    rows = [(None, None, None, None), (5, None, "user", "Q."), (5, None, "assistant", "A."), (5, None, "assistant", "A."), (6, 3, "user", long + "."), (6, 4, "assistant", long), (7, 1, "user", "Q.")]
    rows += [(8, 2, "user", "Same.")] * 50
    got = collected(C.damage_and_repair(frame(spark, rows)))
    by = damaged(rows)
    for kept in by.values():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got[8] == plain(by[8]) and got[6] == plain(by[6]) and got[7] == plain(by[7])
    assert set(got) == {None, 5, 6, 7, 8}
    assert C.damage_and_repair(frame(spark, [])).count() == 0


def test_sql_says_the_same():
    rows = some(21, 150)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: tuple(r[1:]) for r in con.execute(C.SQL).fetchall()}
    assert got == {conv: plain(kept) for conv, kept in damaged(rows).items()}


def test_repaired_rows_are_in_order(spark):
    rows = C.placed(C.damaged(frame(spark, some(9, 60))))
    audit = C.cheapest(C.faults(rows))
    letters = {r.conv: r.a for r in audit.groupBy("conv").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "letters")))["letters"], "").alias("a")).collect()}
    found = {}
    for r in C.repaired_rows(rows, audit).orderBy("pos", "place").collect():
        found.setdefault(r.conv, []).append(r)
    for conv, kept in found.items():
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in kept))
        assert "".join(r.edit for r in kept) == letters[conv].upper().replace("D", "")
