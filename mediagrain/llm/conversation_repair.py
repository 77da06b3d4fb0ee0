"""Conversation structure repair by depth-first branch-and-bound.

A conversation is repaired if the initials of its roles read `(s?(ua)+)?`. Its rows, by turn, are kept (cost 0),
get the role user or assistant (1) or are deleted (2); empty turns of user or assistant may be inserted
anywhere (5). Blank and repeated rows must go; a row that breaks off costs 5 more unless it goes. Of the
cheapest edits the one whose letters (D, I, K, R) come first is taken: the audit. Steps:

1. `repairs`: a row of a conversation shrinks to its turn, a digest and a code of one byte (initial and
   fault), is dealt out by conversation and sorted; repeats are found by a window. A task reads the codes in
   order and searches `CHUNK` rows at a time (`search`): an explicit stack; for each suffix a lower bound,
   the dearest split of it into runs of up to three rows, each at the least cost in any state; an incumbent
   (cost, audit); and for each row and state a table of the best prefix so far, which drops prefixes that
   are no cheaper and no earlier. The search ends when the stack is empty, which proves the optimum. Between
   chunks the last table goes on as the roots of the next search, so nothing is lost by cutting, and the work
   grows with the rows (measured: some 30 microseconds a row; in one search of 256 rows up to 5 000 times that).
2. `repaired`: the audits and the rows are dealt out by conversation, the audit first, and the edits are
   applied to the rows as they stream by. A conversation is never held: what is, is a byte a row in step 1
   and the audit in step 2. As SHA-256 takes a conversation's text in order, one task reads a conversation.

Nulls and odd cases: a null role or text is one space, so such a text is blank; null turns come first and
count in no gap; a null conversation is one like others; an empty role has no initial, so it fits anywhere,
but beside it every pair is illegal; rows of one turn are taken in the order of the SHA-256 digest of role
and text (equal rows in any order); an empty table gives no rows; columns that aren't named are never looked at.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediagrain.llm.components import written
from mediagrain.llm.textkit import bounded_batches

SPACE = " \t\n\x0b\x0c\r"
CHUNK = 16

#: What came last: nothing, a system turn, a user turn, an assistant turn; and what a user's or assistant's turn that may follow makes of it.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
DONE = (START, ASSISTANT)
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: How far the best ends from two states can lie apart: two inserted turns.
SPAN = 2 * INSERT

#: A row's code: 3 * the place of its initial here (the last: any other) + its fault (0 none, 1 must go, 2 breaks off).
INITIALS = ("s", "u", "a", "", None)
CLEAN, MUST_GO, BREAKS_OFF = range(3)


def kept_state(state: int, initial: str | None) -> int | None:
    """The state after a kept row, or None if it can't be kept."""
    if initial == "":
        return state
    if initial == "s":
        return SYSTEM if state == START else None
    return FOLLOWS[state] if initial == "ua"[FOLLOWS[state] - USER] else None


def moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: (letter, cost, next state)."""
    initial, fault = INITIALS[code // 3], code % 3
    out = [("D", DELETE, state)]
    if fault != MUST_GO:
        more = BROKEN if fault == BREAKS_OFF else 0
        if (after := kept_state(state, initial)) is not None:
            out.append(("K", more, after))
        out.append(("R", REROLE + more, FOLLOWS[state]))
    return out


MOVES = [[moves(code, state) for state in range(4)] for code in range(3 * len(INITIALS))]


@lru_cache(None)
def least(codes: bytes, last: bool) -> int:
    """The least cost of a run of rows, whatever state it begins in; it ends in any state or, if it is the last, in one that is done."""
    costs = [0] * 4
    for code in [*codes, None]:
        for _ in range(2):
            for state in range(4):
                costs[FOLLOWS[state]] = min(costs[FOLLOWS[state]], costs[state] + INSERT)
        if code is not None:
            after = [DELETE * 2 * len(codes) + BROKEN * 9] * 4
            for state in range(4):
                for _, cost, to in MOVES[code][state]:
                    after[to] = min(after[to], costs[state] + cost)
            costs = after
    return min(costs[s] for s in DONE) if last else min(costs)


def bounds(codes: bytes, last: bool) -> list[int]:
    """For each row a lower bound on the cost from there on."""
    n = len(codes)
    out = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        out[i] = max(least(codes[i:j], last and j == n) + out[j] for j in range(i + 1, min(i + 3, n) + 1))
    return out


def search(codes: bytes, roots: list[tuple[int, int, int]], last: bool) -> list[tuple[int, int, int, str]]:
    """The best (cost, root's place, audit) of each end state, as (state, cost, place, audit); of the last chunk only the optimum.

    roots: (state, cost, place), the place by the order of the roots' audits. A prefix's rank is (cost, place, audit).
    """
    n, bound = len(codes), bounds(codes, last)
    best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]  # dominance tables
    incumbent, slack = None, 0 if last else SPAN
    stack = sorted(((cost + bound[0], cost, place, "", 0, state) for state, cost, place in roots), reverse=True)
    while stack:
        reach, cost, place, audit, i, state = stack.pop()
        if incumbent is not None:
            if reach > incumbent[0] + slack:
                continue
            if last and reach == incumbent[0] and (place, audit) > (incumbent[1], incumbent[2][: len(audit)]):
                continue
        rank = (cost, place, audit)
        if state in best[i] and best[i][state] <= rank:
            continue
        best[i][state] = rank
        if i == n:
            if (not last or state in DONE) and (incumbent is None or rank < incumbent):
                incumbent = rank
            if not last:
                continue
        nodes = [(cost + INSERT + bound[i], cost + INSERT, place, audit + "I", i, FOLLOWS[state])]
        if i < n:
            nodes += [(cost + c + bound[i + 1], cost + c, place, audit + letter, i + 1, to) for letter, c, to in MOVES[codes[i]][state]]
        nodes.sort(reverse=True)
        stack += nodes
    if last:
        return [(START, *incumbent)]
    return [(state, *rank) for state, rank in best[n].items() if rank[0] <= incumbent[0] + slack]


def cheapest(codes: bytes, chunk: int = CHUNK) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    roots, audits = [(START, 0, 0)], [""]
    for i in range(0, max(len(codes), 1), chunk):
        ends = search(codes[i : i + chunk], roots, i + chunk >= len(codes))
        ends = sorted((audits[place] + audit, state, cost) for state, cost, place, audit in ends)
        audits = [audit for audit, _, _ in ends]
        roots = [(state, cost, place) for place, (_, state, cost) in enumerate(ends)]
    return roots[0][1], audits[0]


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: a space) and the digest of the last two."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return out.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest")]


REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is counted and coded of a conversation while its rows go by."""

    def __init__(self, name):
        self.name, self.codes, self.turns, self.low, self.high = name, bytearray(), 0, None, None
        self.faults, self.illegal, self.initial = [0, 0, 0, 0], 0, None

    def add(self, turn, initial, fault):
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.codes and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        self.codes.append(3 * (INITIALS.index(initial) if initial in INITIALS else len(INITIALS) - 1) + (CLEAN, MUST_GO, MUST_GO, BREAKS_OFF)[fault])

    def repair(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.name, gaps, *self.faults[1:], self.illegal, *cheapest(bytes(self.codes))


def repairs(rows: DataFrame) -> DataFrame:
    """For each conversation of `rows` (conv_id, turn, role, text): gaps, faults, illegal pairs, and the cheapest repair's cost and audit."""
    bounded_batches(rows.sparkSession)
    trimmed = F.rtrim("text", F.lit(SPACE))
    coded = _plain(rows).select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), ~F.substring(trimmed, -1, 1).isin(*".!?")).toDF("conv_id", "turn", "digest", "initial", "blank", "open")
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("open"), 3).otherwise(0).alias("fault")
    coded = coded.repartition("conv_id").withColumn("again", again).select("conv_id", "turn", "digest", "initial", fault)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, schema = None, None
        for batch in batches:
            done, schema = [], batch.schema.field("conv_id").type
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
                if now is None or name != now.name:
                    if now is not None:
                        done.append(now.repair())
                    now = _Conversation(name)
                now.add(*row)
            yield _repair_batch(done, schema)
        if now is not None:
            yield _repair_batch([now.repair()], schema)

    return coded.sortWithinPartitions("conv_id", *_in_order()).select("conv_id", "turn", "initial", "fault").mapInArrow(run, f"conv_id {kind}, {REPAIR}")


def _repair_batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [()] * 8
    kinds = [kind, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *(x.split()[0] for x in REPAIR.split(", "))])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The conversations after the edits of `audits` (conv_id, audit): conv_id, seq, edit (D, I, K, R), role, text.

    Deleted rows are there with edit D. The rows of a conversation stand together and in order in one task.
    """
    bounded_batches(rows.sparkSession)
    heads = audits.select("conv_id", F.lit(0).alias("part"), F.col("audit").alias("text"))
    both = heads.unionByName(_plain(rows).withColumn("part", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", *_in_order()).select("conv_id", "part", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        audit, at, seq, state = "", 0, 0, START
        for batch in batches:
            out = []  # (row of the batch, seq, edit, role); an inserted turn has a head's row, whose text isn't taken
            names = batch.column("role").to_pylist()
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part == 0:
                    audit, at, seq, state = batch.column("text")[i].as_py(), 0, 0, START
                else:
                    edit, at, role = audit[at], at + 1, names[i]
                    if edit == "K":
                        state = kept_state(state, role[:1])
                    elif edit == "R":
                        state = FOLLOWS[state]
                        role = "user" if state == USER else "assistant"
                    out.append((i, seq, edit, role))
                    seq += 1
                while at < len(audit) and audit[at] == "I":
                    state, at = FOLLOWS[state], at + 1
                    out.append((i, seq, "I", "user" if state == USER else "assistant"))
                    seq += 1
            rows_, seqs, edits, roles = zip(*out, strict=True) if out else [()] * 4
            taken = batch.take(pa.array(rows_, pa.int64()))
            edits = pa.array(edits, pa.string())
            text = pc.if_else(pc.equal(edits, "I"), "", taken.column("text"))
            yield pa.RecordBatch.from_arrays([taken.column("conv_id"), pa.array(seqs, pa.int64()), edits, pa.array(roles, pa.string()), text], names=["conv_id", "seq", "edit", "role", "text"])

    return both.mapInArrow(run, f"conv_id {kind}, seq long, edit string, role string, text string")


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of `repaired`: their `role:text`, joined by newlines, without deleted rows."""
    kind = edited.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, own, first, schema = None, None, True, None
        batch_of = lambda done: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            done, schema = [], batch.schema.field("conv_id").type
            for name, seq, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "edit", "role", "text")), strict=True):
                if seq == 0:
                    if own is not None:
                        done.append((now, own.hexdigest()))
                    now, own, first = name, hashlib.sha256(), True
                if edit != "D":
                    own.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield batch_of(done)
        if own is not None:
            yield batch_of([(now, own.hexdigest())])

    return edited.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with faults put in by the hash of conversation and turn."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(name) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    left = rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return left.drop("copy")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    faulty = damaged(rows)
    found = written(repairs(faulty), "repairs")
    ids = rows.select("conv_id").distinct()
    out = ids.join(found.withColumnRenamed("conv_id", "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left")
    out = out.join(digests(repaired(faulty, found)).withColumnRenamed("conv_id", "c2"), F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same as a fold: for each row the best (cost, audit) and repaired turns of every state, with up to two turns inserted before it.
SQL12 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [1,2,3,4,5,6,7,8]::BIGINT[]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 AS f FROM c),
w AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS i, left(role, 1) AS init,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM w),
g AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS init_before FROM o),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE init_before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
v(frm, put, nxt) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
x AS (SELECT a.frm, 0 AS cost, '' AS letters, []::VARCHAR[] AS turns, a.frm AS nxt FROM v a UNION ALL SELECT a.frm, 5, 'I', [a.put || ':'], a.nxt FROM v a
  UNION ALL SELECT a.frm, 10, 'II', [a.put || ':', b.put || ':'], b.nxt FROM v a JOIN v b ON b.frm = a.nxt),
e AS (SELECT g.conv_id, g.i, v.frm, m.letter, m.cost, m.nxt, m.said FROM g CROSS JOIN v CROSS JOIN LATERAL (
  SELECT 'D' AS letter, 2 AS cost, v.frm AS nxt, []::VARCHAR[] AS said
  UNION ALL SELECT 'R', 1 + CASE fault WHEN 3 THEN 5 ELSE 0 END, v.nxt, [v.put || ':' || g.text] WHERE fault NOT IN (1, 2)
  UNION ALL SELECT 'K', CASE fault WHEN 3 THEN 5 ELSE 0 END, CASE WHEN init = '' THEN v.frm WHEN init = 's' THEN 1 ELSE v.nxt END, [g.role || ':' || g.text]
    WHERE fault NOT IN (1, 2) AND (init = '' OR init = left(v.put, 1) OR (init = 's' AND v.frm = 0))) m),
b AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM n
  UNION ALL SELECT conv_id, i, state, best.cost, best.audit, best.said FROM (
    SELECT b.conv_id, e.i, e.nxt AS state, min({'cost': b.cost + x.cost + e.cost, 'audit': b.audit || x.letters || e.letter, 'said': list_concat(list_concat(b.said, x.turns), e.said)}) AS best
    FROM b JOIN x ON x.frm = b.state JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.frm = x.nxt GROUP BY b.conv_id, e.i, e.nxt)),
r AS (SELECT b.conv_id, min({'cost': b.cost + x.cost, 'audit': b.audit || x.letters, 'said': list_concat(b.said, x.turns)}) AS best FROM b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.rows = b.i JOIN x ON x.frm = b.state WHERE x.nxt IN (0, 3) GROUP BY b.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id
"""
