"""Repair of conversations by the cheapest edits, found by A* on the edit lattice.

A conversation is sound if the initials of its roles read (s?(ua)+)?, no turn is
blank or a repetition, and none is cut off.  Edits of one row: Keep 0, Rerole to
user or assistant 1, Delete 2 (the only edit of a blank or repeated row); Insert
an empty user or assistant row 5; a cut-off row that stays adds 5.

A node of the lattice is (rows consumed, part of the pattern reached).  The
heuristic is a suffix sum: 2 for each row that must be deleted, and 2 for each
cut-off row, as deleting it is the least that any path pays for it.  It is
consistent, and the queue is ordered by (cost plus heuristic, audit), so the
first path to reach a node is the cheapest, and of equally cheap ones the one
whose audit is least in ASCII order.  A conversation of more than BLOCK rows is
searched block by block: costs between the states at block ends are found first,
then each block is searched with what remains from its end as a terminal charge;
the result is the same and the work stays linear.

Rows travel without their texts, one symbol each, until the edits are known; a
conversation's symbols are as long as its audit.  Texts are shuffled once and
streamed in order through the edits, so no conversation is held in memory.

Defined results: null roles and texts count as one space; rows come by turn,
nulls first, then by role and by the MD5 of the text, and equal rows follow each
other; a role whose initial is none of s, u, a (or that is empty) cannot be kept;
a conversation of which no row is left, and one whose rows all go, is empty; a
null conv_id is a conversation of its own; texts and conversations of any length
are whole; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import discard, lean, partitions, ship, written

#: Costs of the edits and the charge for a cut-off row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows searched at once, and symbols of one row on the way.
BLOCK, FRAGMENT = 256, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: Parts of the pattern: nothing yet, after s, after u, after a; a conversation may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FULL = {USER: "user", ASSISTANT: "assistant"}
ROLES, SOUND, CUT, BLANK, REPEATED = "sua", 0, 1, 2, 3
NEVER = 1 << 60


def symbol(role: int, fault: int) -> str:
    """One letter for a row: its initial's place in ROLES (3: none of them) and its first fault."""
    return chr(65 + 4 * role + fault)


def added(state: int) -> int:
    """The state after a user or assistant row that fits."""
    return ASSISTANT if state == USER else USER


def kept(state: int, role: int) -> int | None:
    """The state after keeping a row, None where the pattern forbids it."""
    if role == 0:
        return SYSTEM if state == START else None
    return added(state) if role == (2 if state == USER else 1) else None


def floors(symbols: str) -> list[int]:
    """What any path still pays from each place on: the heuristic."""
    out = [0] * (len(symbols) + 1)
    for i in range(len(symbols) - 1, -1, -1):
        out[i] = out[i + 1] + (DELETE if (ord(symbols[i]) - 65) % 4 else 0)
    return out


def steps(symbols: str, i: int, state: int):
    """Edits at a node: letter, cost, next place, next state."""
    yield "I", INSERT, i, added(state)
    if i == len(symbols):
        return
    role, fault = divmod(ord(symbols[i]) - 65, 4)
    yield "D", DELETE, i + 1, state
    if fault in (BLANK, REPEATED):
        return
    charge = CUT_OFF if fault == CUT else 0
    if (after := kept(state, role)) is not None:
        yield "K", charge, i + 1, after
    yield "R", REROLE + charge, i + 1, added(state)


def search(symbols: str, state: int, after: tuple[int, ...]) -> tuple[int, str, int]:
    """Cost, audit and last state of the cheapest path, whose end in each state costs ``after`` more."""
    floor, least = floors(symbols), min(after)
    queue, done = [(floor[0] + least, "", 0, state, 0)], set()
    while queue:
        _, audit, i, state, cost = heappop(queue)
        if i > len(symbols):
            return cost, audit, state
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(symbols) and after[state] < NEVER:
            heappush(queue, (cost + after[state], audit, i + 1, state, cost + after[state]))
        for letter, price, j, to in steps(symbols, i, state):
            if (j, to) not in done:
                heappush(queue, (cost + price + floor[j] + least, audit + letter, j, to, cost + price))
    return NEVER, "", state


def between(symbols: str, state: int) -> tuple[int, ...]:
    """The least cost of reaching each state at the end of ``symbols``."""
    out = []
    for end in range(4):
        out.append(search(symbols, state, tuple(0 if k == end else NEVER for k in range(4)))[0])
    return tuple(out)


ENDS = (0, NEVER, NEVER, 0)


@lru_cache(maxsize=1 << 15)
def short(symbols: str) -> tuple[int, str]:
    return search(symbols, START, ENDS)[:2]


def cheapest(symbols: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the best repair."""
    if len(symbols) <= block:
        return short(symbols)
    blocks = [symbols[k : k + block] for k in range(0, len(symbols), block)]
    after = [ENDS]
    for b in reversed(blocks[1:]):
        after.append(tuple(min(NEVER, min(c + r for c, r in zip(between(b, s), after[-1]))) for s in range(4)))
    state, audits, total = START, [], None
    for b, rest in zip(blocks, reversed(after)):
        cost, audit, state = search(b, state, rest)
        total = cost if total is None else total
        audits.append(audit)
    return total, "".join(audits)


def counted(symbols: str) -> tuple[int, int, int, int]:
    """Blank, repeated and cut-off rows, and neighbours whose initials are not su, ua or au."""
    codes = [divmod(ord(x) - 65, 4) for x in symbols]
    faults = [f for _, f in codes]
    illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for (a, _), (b, _) in zip(codes, codes[1:]))
    return faults.count(BLANK), faults.count(REPEATED), faults.count(CUT), illegal


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by a hash of conversation and turn, with the number of their copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def own_fault(text: Column) -> Column:
    """BLANK, CUT or SOUND, from the text alone."""
    end = F.rtrim(text, F.lit(BLANKS))
    return F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)





def in_order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def turns(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, written: their number, initial and own fault."""
    digest = F.md5(F.col("text").cast("binary"))
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1)).cast("int")
    own = rows.select("conv_id", "turn", "role", digest.alias("digest"), "copies", own_fault(F.col("text")).alias("own"), F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"))
    return written(own.groupBy("conv_id", "turn", "role", "digest", "own", "initial").agg(F.sum("copies").alias("n")), "turns")


def faults(each: DataFrame) -> DataFrame:
    """The symbols of the first and of later copies of each distinct row."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = each.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    both = each.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = F.when(F.col("own") == BLANK, BLANK).when(place > F.col("first"), REPEATED).otherwise(F.col("own"))
    later = F.when(F.col("own") == BLANK, BLANK).otherwise(REPEATED)
    letter = lambda f: F.char(F.lit(65) + 4 * F.col("initial") + f)
    return both.select("conv_id", "turn", "role", "digest", "n", letter(fault).alias("head"), letter(later).alias("tail"))


def symbols(each: DataFrame) -> DataFrame:
    """conv_id and the symbols of its rows in order.

    Rows are dealt by range, so a long conversation is spread over tasks; each
    task writes one string for each conversation it meets.
    """

    def run(batches):
        from pyspark import TaskContext

        part, at, k, held = TaskContext.get().partitionId(), None, 0, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([k], pa.int64()), pa.array(["".join(held)])], ["conv_id", "part", "k", "symbols"])

        size = 0
        for batch in batches:
            for conv, n, head, tail in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if at is not None and (at[0] != conv or size >= FRAGMENT):
                    yield flush()
                    k, held, size = k + 1, [], 0
                at = (conv,)
                held.append(head + tail * (n - 1))
                size += n
        if at is not None:
            yield flush()

    dealt = faults(each).repartitionByRange(partitions(each), *in_order()).sortWithinPartitions(*in_order()).select(F.col("conv_id").cast("long"), "n", "head", "tail")
    pieces = dealt.mapInArrow(lean(run), "conv_id long, part int, k long, symbols string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "symbols"))), lambda x: x.symbols), "")
    return pieces.groupBy("conv_id").agg(whole.alias("symbols"))


def edits(each: DataFrame) -> DataFrame:
    """conv_id, faults, cost and audit of each conversation that has rows."""

    def run(batches):
        for batch in batches:
            ids, strings = batch.column(0), batch.column(1).to_pylist()
            found = [(*counted(s), *cheapest(s)) for s in strings]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return symbols(each).mapInArrow(lean(run), "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def applied(audit: str, rows):
    """The repaired rows, as role and text, of the given ones in order."""
    state, rows = START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = kept(state, ROLES.index(role[:1]))
        else:
            state = added(state)
            role = FULL[state]
        yield role, text


def heads(rows: DataFrame, each: DataFrame) -> DataFrame:
    """One row for each original conversation, with its gaps, faults, cost and audit."""
    known = rows.select(F.col("conv_id").cast("long")).distinct()
    by_turn = each.select(F.col("conv_id").cast("long").alias("g"), "turn").distinct().groupBy("g").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = edits(each).withColumnRenamed("conv_id", "e")
    d = known.join(by_turn, F.col("conv_id").eqNullSafe(F.col("g")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("e")), "left")
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


HEAD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def streamed(broken: DataFrame, head: DataFrame) -> DataFrame:
    """Each conversation's head, then its damaged rows in order, in one partition, sorted; this is where texts are shuffled."""
    texts = broken.select(F.col("conv_id").cast("long"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text", "copies", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in HEAD])
    tops = head.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), *HEAD)
    both = tops.withColumn("row", F.lit(False)).unionByName(texts.withColumn("row", F.lit(True)))
    return both.repartition(partitions(broken), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "row", F.col("turn").asc_nulls_first(), "role", "digest").select("row", "conv_id", "role", "text", "copies", *HEAD)


def conversations_of(batches):
    """From streamed batches: each head and an iterator of its rows, which must be used up first."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(b.num_columns))))
    waiting = next(rows, None)

    def own():
        nonlocal waiting
        waiting = next(rows, None)
        while waiting is not None and waiting[0]:
            for _ in range(waiting[4]):
                yield waiting[2], waiting[3]
            waiting = next(rows, None)

    while waiting is not None:
        head = waiting
        inside = own()
        yield head, inside
        for _ in inside:  # what was not used
            pass


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The damaged rows, and the written heads with their edits."""
    ship(rows.sparkSession)
    broken = damaged(rows)
    each = turns(broken)
    head = written(heads(rows, each), "edits")
    discard(each)
    return broken, head


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    broken, head = plan(rows)

    def run(batches):
        held = []
        for top, inside in conversations_of(batches):
            for place, (role, text) in enumerate(applied(top[-1], inside)):
                held.append((top[1], place, role, text))
                if len(held) == 512:
                    yield batch_of(held)
                    held = []
        yield batch_of(held)

    def batch_of(held):
        ids, places, roles, texts = zip(*held) if held else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "place", "role", "text"])

    return streamed(broken, head).mapInArrow(lean(run), "conv_id long, place long, role string, text string")


def summary(rows: DataFrame) -> DataFrame:
    """One row for each original conversation: gaps, faults, cost, audit, and a digest of the repaired rows."""
    broken, head = plan(rows)

    def digest(audit, inside):
        h, first = hashlib.sha256(), True
        for role, text in applied(audit, inside):
            h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        return h.hexdigest()

    def run(batches):
        held = []
        for top, inside in conversations_of(batches):
            held.append((top[1], *top[5:], digest(top[-1], inside)))
            if len(held) == 1024:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    def batch_of(held):
        columns = list(zip(*held)) or [()] * 9
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())], ["conv_id", *HEAD, "repaired_sha256"])

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return streamed(broken, head).mapInArrow(lean(run), schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    """The lattice as a recursion over rows: for each state the least (cost, audit), as one sortable text with the repaired rows in hex."""

    def add(x: str, cost: str, letter: str, piece: str = "''") -> str:
        return f"lpad((substr({x}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || split_part(substr({x}, 10), '|', 1) || '{letter}' || '|' || split_part({x}, '|', 2) || {piece}"

    user, assistant = ("'0A" + f"{r}:".encode().hex().upper() + "'" for r in ("user", "assistant"))
    best = lambda *x: f"least({', '.join(x)})"
    stays = lambda x, cost, letter, piece, when="true": f"CASE WHEN NOT gone AND {when} THEN {add(x, cost, letter, piece)} END"
    to_user = [y for x in ("z", "s", "a1") for y in (stays(x, "charge", "K", "same", "initial = 'u'"), stays(x, "1 + charge", "R", f"{user} || body"))]
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(4 * length(x)), lambda i: (((strpos('0123456789ABCDEF', substr(x, 2 * (i // 8) + (CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END), 1)) - 1) >> (i % 4)::INT) & 1)::BIGINT),
    lambda c, y: xor(c >> 1, (xor(c, y) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM raw),
broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM broken),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM numbered),
judged AS (
  SELECT conv_id, turn, i, initial, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    hex(encode(text)) AS body, '0A' || hex(encode(role || ':' || text)) AS same FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) AS n FROM judged GROUP BY conv_id),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair, lead(i) OVER (PARTITION BY conv_id ORDER BY i) IS NOT NULL AS next FROM judged),
illegal AS (SELECT conv_id, count(*) FILTER (next AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
steps AS (SELECT conv_id, i, initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS charge, body, same FROM judged),
lattice AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000|' AS z, NULL::VARCHAR AS s, {add("'000000000|'", "5", "I", user)} AS u1, {add(add("'000000000|'", "5", "I", user), "5", "I", assistant)} AS a1 FROM counts
  UNION ALL
  SELECT conv_id, i, z, s, {best("u", add("z", "5", "I", user), add("s", "5", "I", user), add("a", "5", "I", user))} AS u1,
    {best("a", add("u", "5", "I", assistant), add(add("z", "5", "I", user), "5", "I", assistant), add(add("s", "5", "I", user), "5", "I", assistant))} AS a1
  FROM (
    SELECT l.conv_id, r.i, {add("z", "2", "D")} AS z, {best(add("s", "2", "D"), stays("z", "charge", "K", "same", "initial = 's'"))} AS s,
      {best(add("u1", "2", "D"), *to_user)} AS u,
      {best(add("a1", "2", "D"), stays("u1", "charge", "K", "same", "initial = 'a'"), stays("u1", "1 + charge", "R", f"{assistant} || body"))} AS a
    FROM lattice l JOIN steps r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = l.i + 1)),
ends AS (SELECT l.conv_id, least(z, a1) AS e FROM lattice l JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.n)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(e, 1, 9)::BIGINT, 0) AS cost, coalesce(split_part(substr(e, 10), '|', 1), '') AS audit, sha256(unhex(substr(coalesce(split_part(e, '|', 2), ''), 3))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN illegal g ON k.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends e ON k.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP12_SQL = _sql()
