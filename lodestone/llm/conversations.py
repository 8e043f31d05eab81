"""Repair of conversations whose turns are blank, repeated, cut short or out of order, by cheapest edits.

A conversation's rows, in order of turn, are a chain; a repaired one has the role initials (s?(ua)+)?, whose automaton has four states. Edits
are arcs over (row, state): keep, rerole, delete, insert, of small integer costs, so Dial's bucket queue settles the distances to the end
without a heap. From the start a walk takes, of the tight arcs, the one of least letter: of the cheapest audits the ASCII-least.

A conversation may hold a third of all rows. It is cut into blocks of BLOCK rows, each a byte a row; a block's costs from each state to each are a
4 x 4 matrix. One pass over a conversation's matrices, from its end, gives every block the distances at its end; then the blocks are walked
apart from each other, from each of the four states; and one pass from the front says which of the four walks holds. These passes stream 4 or 16 numbers for
BLOCK rows. Only a digest over a conversation's whole text is serial by its nature: its rows pass one task in order, and none is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import SPACES, cut
from .components import reshuffled

#: Rows of a block.
BLOCK = 4096
#: What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: at the start, after the system's row, after the user's, after the assistant's. Where each initial leads from there.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = (0, 3)
#: The role that a state asks for next, where it isn't the system's.
WANTS = ["user", "user", "assistant", "user"]
STATES, INITIALS, FAR = 4, "sua?", 1 << 60
#: A row's code is its initial's place plus 4 if truncated, 8 if it has to go.
LATE, GONE = 4, 8
#: Adjacent initials that are in order.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def arcs(code: int) -> list[tuple[str, int, int, int]]:
    """letter, from, to, cost of the arcs over a row."""
    out = [("D", q, q, DELETE) for q in range(STATES)]
    if code < GONE:
        late = TRUNCATED if code >= LATE else 0
        initial = INITIALS[code % 4]
        for q in range(STATES):
            if initial in STEP[q]:
                out.append(("K", q, STEP[q][initial], KEEP + late))
            out.append(("R", q, STEP[q][WANTS[q][0]], REROLE + late))
    return out


ARCS = [arcs(code) for code in range(12)]
#: letter, to, cost by code and state, in order of letters; from, cost by code and state that is reached.
ON = [[sorted((letter, to, cost) for letter, q, to, cost in of if q == at) for at in range(STATES)] for of in ARCS]
BACK = [[[(q, cost) for _, q, to, cost in of if to == at] for at in range(STATES)] for of in ARCS]
INSERTED = [STEP[q][WANTS[q][0]] for q in range(STATES)]
BEFORE = [[q for q in range(STATES) if INSERTED[q] == at] for at in range(STATES)]


def distances(codes: bytes, last: list[int], closed: bool = False) -> list[int]:
    """The least cost from every (row, state), at row * 4 + state, given that at the block's end. Rows are inserted before the block's rows; at its end only
    where it is closed. Dial: nodes wait in the bucket of their distance, and buckets are emptied from the least on."""
    n = len(codes)
    dist, done = [FAR] * (STATES * (n + 1)), bytearray(STATES * (n + 1))
    low = min(last)
    buckets: list[list[int]] = [[]]

    def reach(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            while len(buckets) <= d - low:
                buckets.append([])
            buckets[d - low].append(node)

    for q in range(STATES):
        if last[q] < FAR:
            reach(n * STATES + q, last[q])
    at = 0
    while at < len(buckets):
        bucket = buckets[at]
        d = at + low
        for node in bucket:  # arcs of cost 0 add to it meanwhile
            if done[node]:
                continue
            done[node] = 1
            i, q = divmod(node, STATES)
            if i < n or closed:
                for p in BEFORE[q]:
                    reach(i * STATES + p, d + INSERT)
            if i:
                for p, cost in BACK[codes[i - 1]][q]:
                    reach((i - 1) * STATES + p, d + cost)
        buckets[at] = ()
        at += 1
    return dist


#: The distances after the last row, where rows may still be inserted.
FINISH = distances(b"", [0 if q in ENDS else FAR for q in range(STATES)], closed=True)


def matrix(codes: bytes) -> list[int]:
    """The least cost over a block from each state to each, by rows."""
    to = [distances(codes, [0 if q == end else FAR for q in range(STATES)]) for end in range(STATES)]
    return [to[end][q] for q in range(STATES) for end in range(STATES)]


def walk(codes: bytes, dist: list[int], state: int) -> tuple[str, int]:
    """The letters of the least cheapest way through a block, and the state at its end. What makes an assistant's row has a small letter."""
    out, i, n = [], 0, len(codes)
    while i < n:
        here, after = i * STATES, (i + 1) * STATES
        ways = [(letter, after + to) for letter, to, cost in ON[codes[i]][state] if dist[here + state] == cost + dist[after + to]]
        if dist[here + state] == INSERT + dist[here + INSERTED[state]]:
            ways.append(("I", here + INSERTED[state]))
        letter, node = min(ways)
        out.append(letter.lower() if letter in "IR" and WANTS[state] == "assistant" else letter)
        i, state = divmod(node, STATES)
    return "".join(out), state


def tail(state: int) -> str:
    """The rows to insert at a conversation's end."""
    out = ""
    while FINISH[state]:
        out += "i" if WANTS[state] == "assistant" else "I"
        state = INSERTED[state]
    return out


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of conversations as noise leaves them, by crc32 of key:turn mod 20: 0 drops a row, 1 empties its text, 2 removes its . ! ?, 3 repeats it,
    4 makes it the user's. A null role or text is one space, and so is a null key or turn in what is hashed."""
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    rows = conversations.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("h"))
    new_role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    new_text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")
    return rows.where("h != 0").select("conv", "turn", new_role.alias("role"), new_text.alias("text"), copies).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """Rows of conv, turn, role, text with pos, a number that grows in order of conversation and turn (nulls first), then role and a hash of the text: one
    range-partitioned sort. Equal rows are beside each other, and may be dealt over several tasks."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "_h", "_tie"]
    tied = rows.select("conv", "turn", "role", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_tie"))
    return cut(tied.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, pos, fault (blank, duplicate, truncated or null) and code of placed rows. Of a conversation's rows with one role and text all but the first are
    duplicates."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    same = ["conv", "role", "digest"]
    each = rows.select("conv", "turn", "pos", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("late"))
    each = cut(each)
    firsts = each.groupBy(*same).agg(F.min("pos").alias("first")).select("first")
    joined = each.join(firsts, F.col("pos") == F.col("first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("late"), "truncated")
    initial: Column = F.lit(3)
    for place, letter in enumerate(INITIALS[:3]):
        initial = F.when(F.left("role", F.lit(1)) == letter, place).otherwise(initial)
    marked = joined.select("conv", "turn", "pos", fault.alias("fault"), initial.alias("initial"))
    code = F.col("initial") + F.when(F.col("fault") == "truncated", LATE).when(F.col("fault").isNotNull(), GONE).otherwise(0)
    return marked.select("conv", "turn", "pos", "fault", code.cast("int").alias("code"))


def fields(conv: StructField, *more: tuple[str, object]) -> StructType:
    return StructType([conv, *[StructField(name, kind) for name, kind in more]])


def blocks(marked: DataFrame) -> DataFrame:
    """conv, at (the first row's pos), codes (a byte a row), illegal (adjacent initials out of order), costs (4 x 4) of each block of rows."""
    schema = fields(marked.schema["conv"], ("at", LongType()), ("codes", BinaryType()), ("illegal", LongType()), ("costs", ArrayType(LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, codes, out = None, 0, bytearray(), []

        def close() -> None:
            if codes:
                wrong = sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
                out.append((conv, at, bytes(codes), wrong, matrix(bytes(codes))))

        for batch in batches:
            for c, p, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv or p != at + len(codes) or len(codes) >= BLOCK:
                    close()
                    conv, at, codes = c, p, bytearray()
                codes.append(code)
            if len(out) >= 1000:
                yield as_batch(out, batch.schema.field(0).type)
                out = []
            kind = batch.schema.field(0).type
        close()
        if out:
            yield as_batch(out, kind)

    def as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    return marked.select("conv", "pos", "code").repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(run, schema)


def distances_after(cells: DataFrame) -> DataFrame:
    """Blocks with last: the least cost from each state after the block's rows. One pass over a conversation's matrices, from its end."""
    schema = fields(cells.schema["conv"], ("at", LongType()), ("codes", BinaryType()), ("illegal", LongType()), ("last", ArrayType(LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, last = False, None, FINISH
        for batch in batches:
            out = []
            for c, m in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not began or c != conv:
                    began, conv, last = True, c, FINISH
                out.append(last)
                last = [min(m[q * STATES + end] + last[end] for end in range(STATES)) for q in range(STATES)]
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.list_(pa.int64()))], names=schema.names)

    dealt = cells.repartition("conv").sortWithinPartitions("conv", F.desc("at"))
    return dealt.mapInArrow(run, schema)


def walks(cells: DataFrame) -> DataFrame:
    """Of each block the way through it from each state: letters, ends, and cost from the first state; its first and last initial."""
    more = [("at", LongType()), ("rows", IntegerType()), ("first", IntegerType()), ("final", IntegerType()), ("illegal", LongType()), ("cost", LongType()), ("letters", ArrayType(StringType())), ("ends", ArrayType(IntegerType()))]
    schema = fields(cells.schema["conv"], *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, last in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                dist = distances(codes, last)
                ways = [walk(codes, dist, q) for q in range(STATES)]
                out.append((len(codes), codes[0] % 4, codes[-1] % 4, dist[0], [w[0] for w in ways], [w[1] for w in ways]))
            n, first, final, cost, letters, ends = zip(*out, strict=True) if out else [()] * 6
            arrays = [pa.array(n, pa.int32()), pa.array(first, pa.int32()), pa.array(final, pa.int32()), batch.column(3), pa.array(cost, pa.int64()), pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.record_batch([*batch.columns[:2], *arrays], names=schema.names)

    return reshuffled(cells, "at").mapInArrow(run, schema)


def pieces(ways: DataFrame) -> DataFrame:
    """conv, at, rows, state, letters, illegal, cost: of each block the way that holds, the rows inserted after the last one among them. cost is the conversation's,
    at its first block, else 0. One pass over a conversation's blocks, from the front."""
    more = [("at", LongType()), ("rows", IntegerType()), ("state", IntegerType()), ("letters", StringType()), ("illegal", LongType()), ("cost", LongType())]
    schema = fields(ways.schema["conv"], *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, final, kind = None, 0, None, None

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, at, n, first, end, illegal, cost, letters, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = held is not None and held[0] == conv
                if held is not None:
                    out.append(held if same else (*held[:4], held[4] + tail(state), *held[5:]))
                if not same:
                    state = 0
                wrong = illegal + (same and (final, first) not in LEGAL)
                held = (conv, at, n, state, letters[state], wrong, 0 if same else cost)
                state, final = ends[state], end
            if out:
                yield as_batch(out)
        if held is not None:
            yield as_batch([(*held[:4], held[4] + tail(state), *held[5:])])

    return ways.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(run, schema)


def cheapest(marked: DataFrame) -> DataFrame:
    """The pieces of all conversations' audits, from their faults' codes."""
    return cut(pieces(walks(distances_after(cut(blocks(marked))))))


def repaired_rows(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """conv, pos, place, edit (K, R or I), role, text of the rows that stay, in order of pos and place, from placed rows and the pieces of their audits."""
    schema = fields(audit.schema["conv"], ("pos", LongType()), ("place", IntegerType()), ("edit", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, pos, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = 0
                for letter in letters:
                    if letter != "D":
                        out.append((conv, pos, place, letter))
                    pos, place = (pos, place + 1) if letter in "Ii" else (pos + 1, 0)
                if len(out) >= 20_000:
                    yield as_batch(out, kind)
                    out = []
            if out:
                yield as_batch(out, kind)

    def as_batch(edits: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int32(), pa.string()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*edits, strict=True), types, strict=True)], names=schema.names)

    edits = reshuffled(audit.select("conv", "at", "letters"), "at").mapInArrow(run, schema)
    stays = edits.where("edit not in ('I', 'i')").join(rows.select("pos", "role", "text"), "pos")
    new_role = F.when(F.col("edit") == "R", "user").when(F.col("edit") == "r", "assistant").otherwise(F.col("role"))
    stays = stays.select("conv", "pos", "place", F.upper("edit").alias("edit"), new_role.alias("role"), "text")
    added = edits.where("edit in ('I', 'i')").select("conv", "pos", "place", F.upper("edit").alias("edit"), F.when(F.col("edit") == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    return stays.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """conv, sha256 (hex) of each conversation's role:text, joined by newlines: a stream through one task a conversation, of which nothing is held."""
    schema = fields(repaired.schema["conv"], ("sha256", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, state = False, None, None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if began and c == conv:
                    state.update(b"\n")
                else:
                    if began:
                        out.append((conv, state.hexdigest()))
                    began, conv, state = True, c, hashlib.sha256()
                state.update(line.encode())
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=schema.names)
        if began:
            yield pa.record_batch([pa.array([conv], kind), pa.array([state.hexdigest()])], names=schema.names)

    lines = repaired.select("conv", F.concat_ws(":", "role", "text").alias("line"), "pos", "place")
    return lines.repartition("conv").sortWithinPartitions("conv", "pos", "place").select("conv", "line").mapInArrow(run, schema)


def counts(marked: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated. Turns are counted first by turn, then by conversation."""
    kinds = ("blank", "duplicate", "truncated")
    each = marked.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return each.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(k).cast("long").alias(k) for k in kinds])


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """A row a conversation of `every` (conv): gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 of its repaired rows. rows: conv, turn, role, text.

    conv is of any type that sorts, null a conversation of its own; turn an integer, nulls first and counted in no gap; role and text aren't null. An empty role has no initial,
    so it is out of order and can't be kept. A conversation without rows: zeros, an empty audit, the empty text's digest. Empty table: no rows.
    """
    at = placed(rows)
    marked = cut(faults(at))
    audit = cheapest(marked)
    audits = audit.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "letters"))).alias("p"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    audits = audits.select("conv", "illegal", "cost", F.upper(F.array_join(F.col("p.letters"), "")).alias("audit"))
    out = every.select("conv").distinct()
    for part in (counts(marked), audits, digests(repaired_rows(at, audit))):
        named = part.withColumnRenamed("conv", "_conv")
        out = out.join(named, F.expr("conv <=> _conv"), "left").drop("_conv")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))


def damage_and_repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged as `damaged` says and repaired. Other columns are
    not looked at."""
    done = repair(damaged(conversations, key, turn, role, text), conversations.select(F.col(key).alias("conv")))
    return done.withColumnsRenamed({"conv": key, "sha256": "repaired_sha256"})


def sql_ways(state: int) -> str:
    """The cheapest of the edits of a row in a state, for SQL: structs of cost, audit and lines, of which the least is taken."""

    def way(condition: str, cost: str, letter: str, role: str, to: int) -> str:
        lines = f"{role} || ':' || text || CASE s{to}.lines WHEN '' THEN '' ELSE chr(10) || s{to}.lines END"
        return f"CASE WHEN {condition} THEN {{'cost': {cost} + s{to}.cost, 'audit': '{letter}' || s{to}.audit, 'lines': {lines}}} END"

    keeps = [way(f"stays AND c = '{initial}'", "truncated::BIGINT", "K", "role", to) for initial, to in STEP[state].items()]
    reroled = way("stays", f"{REROLE} + truncated::BIGINT", "R", f"'{WANTS[state]}'", INSERTED[state])
    deleted = f"{{'cost': {DELETE} + s{state}.cost, 'audit': 'D' || s{state}.audit, 'lines': s{state}.lines}}"
    return f"list_min([{', '.join([deleted, *keeps, reroled])}]) AS b{state}"


#: By recursion from each conversation's last row: the cheapest edits from there on in each state. CRC-32 is worked out bit by bit.
SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(
    string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS h FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM o, range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM d),
f AS (SELECT *, solid = '' AS blank, solid <> '' AND seen > 1 AS duplicate, solid <> '' AND seen = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM n)),
w AS (
  SELECT conv_id, max(i) + 1 AS i, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS s0, {'cost': 4::BIGINT, 'audit': 'II', 'lines': 'user:' || chr(10) || 'assistant:'} AS s1,
    {'cost': 2::BIGINT, 'audit': 'I', 'lines': 'assistant:'} AS s2, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS s3 FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([b0, {'cost': 2 + v2.cost, 'audit': 'I' || v2.audit, 'lines': 'user:' || CASE v2.lines WHEN '' THEN '' ELSE chr(10) || v2.lines END}]),
    list_min([b1, {'cost': 2 + v2.cost, 'audit': 'I' || v2.audit, 'lines': 'user:' || CASE v2.lines WHEN '' THEN '' ELSE chr(10) || v2.lines END}]), v2,
    list_min([b3, {'cost': 2 + b2.cost, 'audit': 'I' || b2.audit, 'lines': 'user:' || CASE b2.lines WHEN '' THEN '' ELSE chr(10) || b2.lines END}]) FROM (
    SELECT *, list_min([b2, {'cost': 2 + b3.cost, 'audit': 'I' || b3.audit, 'lines': 'assistant:' || CASE b3.lines WHEN '' THEN '' ELSE chr(10) || b3.lines END}]) AS v2 FROM (
      SELECT conv_id, i, """ + ", ".join(map(sql_ways, range(STATES))) + r""" FROM (SELECT f.*, NOT f.blank AND NOT f.duplicate AS stays, s0, s1, s2, s3 FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i - 1)))),
a AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
  count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(s0.cost, 0)::BIGINT AS cost, coalesce(s0.audit, '') AS audit, sha256(coalesce(s0.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN a ON k.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = 1
"""
