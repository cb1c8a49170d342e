"""Repair of conversations: the cheapest edits to role order, blanks, repeats and cut-off turns, as an audit string.

The edits of a conversation are found by a dynamic program over its turns and four states of the role order ``(s?(ua)+)?``.  Every
prefix of edits is a node that points at the prefix before it, so states share what they have in common.  Nodes keep
ancestors at powers of two and a rolling hash of their edits; of equally cheap prefixes the ASCII-least one stays, found by a
search for the longest common prefix, whose hash matches are verified.

Long conversations are cut into blocks of BLOCK turns.  A block that doesn't start its conversation is solved from every state, and
gives the cost of every pair of states and the order of its edit strings; blocks are chained by these small tables alone, and then
each gives the one string that the chain takes.  Strings are cut before a turn's insertions, so no string is a prefix of another
and the first block that differs decides.  Only flags and hashes take part; texts move once, beside the finished edits.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Turns of a block.
BLOCK = 4096
#: Costs of rerole, delete, insert and of an undeleted truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; the state that an inserted or reroled turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
ONWARD = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Insertions that end a conversation from each state.
TAIL = ("", "II", "I", "")
BASE, PRIME = 1_000_003, (1 << 61) - 1
#: Whitespace of the contract: space and U+0009 to U+000D.
GAPS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT = range(4)


def kept(state: int, initial: str) -> int | None:
    """The state after a turn whose role starts with ``initial``, or None where the order forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


class Prefixes:
    """Edit prefixes as linked nodes; node 0 is the empty one."""

    def __init__(self):
        self.edit, self.up, self.depth, self.hash = [""], [()], [0], [0]

    def add(self, node: int, edits: str) -> int:
        for e in edits:
            above, at = [node], node
            k = 0
            while len(self.up[at]) > k:
                at = self.up[at][k]
                above.append(at)
                k += 1
            self.edit.append(e)
            self.up.append(tuple(above))
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * BASE + ord(e)) % PRIME)
            node = len(self.edit) - 1
        return node

    def lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while self.depth[node]:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two prefixes whose hashes agree are the same edits, by walking until they meet."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def compare(self, a: int, b: int) -> int:
        """Negative, zero or positive as the edits of ``a`` come before, are, or come after those of ``b`` in ASCII order."""
        m = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, self.depth[a] - m), self.lifted(b, self.depth[b] - m)
        if x == y or (self.hash[x] == self.hash[y] and self._same(x, y)):
            return self.depth[a] - self.depth[b]
        i, j = x, y
        for k in range(len(self.up[i]) - 1, -1, -1):
            if k < len(self.up[i]) and self.hash[self.up[i][k]] != self.hash[self.up[j][k]]:
                i, j = self.up[i][k], self.up[j][k]
        if not self._same(self.up[i][0], self.up[j][0]):  # a hash collision: compare the edits themselves
            p, q = self.text(x), self.text(y)
            return -1 if p < q else 1
        return ord(self.edit[i]) - ord(self.edit[j])


def solve(turns: list[tuple[str, int]], start: int) -> list[tuple[int, int, str] | None]:
    """For each state: cost, order among the states' edits, and edits of the cheapest, ASCII-least way there from ``start``, or None.

    ``turns`` are (role initial, fault).  No way ends in insertions: these belong to the next turn.
    """
    nodes = Prefixes()
    ways: list[tuple[int, int] | None] = [None] * 4
    ways[start] = (0, 0)

    def better(x, y) -> bool:
        """Whether way x (cost, node, edits to add) comes before way y."""
        if y is None or x[0] != y[0]:
            return y is None or x[0] < y[0]
        if x[1] == y[1]:
            return x[2] < y[2]
        return nodes.compare(nodes.add(x[1], x[2]), nodes.add(y[1], y[2])) < 0

    for initial, fault in turns:
        open_ = [w and (*w, "") for w in ways]
        for _ in range(2):
            for s in range(4):
                if open_[s]:
                    way = (open_[s][0] + INSERT, open_[s][1], open_[s][2] + "I")
                    if better(way, open_[ONWARD[s]]):
                        open_[ONWARD[s]] = way
        to: list = [None] * 4
        stays = TRUNCATED if fault == CUT else 0
        for s, w in enumerate(open_):
            if w is None:
                continue
            steps = [(s, DELETE, "D")]
            if fault in (FINE, CUT):
                steps.append((ONWARD[s], REROLE + stays, "R"))
                if (t := kept(s, initial)) is not None:
                    steps.append((t, stays, "K"))
            for t, cost, edit in steps:
                way = (w[0] + cost, w[1], w[2] + edit)
                if better(way, to[t]):
                    to[t] = way
        ways = [w and (w[0], nodes.add(w[1], w[2])) for w in to]
    reached = sorted((s for s in range(4) if ways[s]), key=cmp_to_key(lambda s, t: nodes.compare(ways[s][1], ways[t][1])))
    return [(ways[s][0], reached.index(s), nodes.text(ways[s][1])) if ways[s] else None for s in range(4)]


def last_state(ends: list[tuple[int, int] | None]) -> tuple[int, int]:
    """Cost and state of the best end: the cheapest with its tail of insertions, then the least in order."""
    cost, _, state = min((w[0] + INSERT * len(TAIL[s]), w[1], s) for s, w in enumerate(ends) if w)
    return cost, state


def chained(tables: list[list[tuple[int, int] | None]]) -> tuple[int, list[int]]:
    """Cost, and 4 * start + end of every block, of the best way through the (cost, order) ``tables`` of a conversation's blocks."""
    ways: list = [(0, 0), None, None, None]
    back = []
    for table in tables:
        to = {}
        for s in range(4):
            for t in range(4):
                if ways[s] and table[4 * s + t]:
                    cost, order = table[4 * s + t]
                    # strings of different starts differ before this block, those of one start in it
                    to[t] = min(to.get(t, ((1 << 62, 0, 0), 0)), ((ways[s][0] + cost, ways[s][1], order), s))
        order = {t: i for i, (_, t) in enumerate(sorted((w[0][1:], t) for t, w in to.items()))}
        back.append({t: w[1] for t, w in to.items()})
        ways = [(to[t][0][0], order[t]) if t in to else None for t in range(4)]
    cost, state = last_state(ways)
    picks = []
    for b in reversed(back):
        picks.append(4 * b[state] + state)
        state = b[state]
    return cost, picks[::-1]


def _ready(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text, m): nulls as one space, conv_id as text ('' for null), the text's MD5."""
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.withColumn("m", F.unhex(F.md5("text")))


def _turns(ready: DataFrame) -> DataFrame:
    """Different turns (key, turn, role, m, copies, fault, again): fault of the first copy but for duplicates; again tells these."""
    end = F.expr("rtrim(gaps, text)")
    found = ready.withColumn("gaps", F.lit(GAPS)).withColumn("fault", F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT))
    turns = written(found.groupBy("key", "turn", "role", "m").agg(F.count("*").alias("copies"), F.first("fault").alias("fault")), "turns")
    first = turns.groupBy("key", "role", "m").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "repeated")
    return turns.join(small(first), ["key", "role", "m"], "left").withColumn("again", F.expr("first is not null and not (turn <=> first.turn)")).drop("first")


_PIECES = "key string, p int, b int, audit string, cost long, blank long, duplicate long, truncated long, costs array<long>, orders array<int>, audits array<string>"


def _blocks(batches):
    """Blocks of edits of one range of turns; the first and the last conversation of a range, and those of several blocks, stay open."""
    p = TaskContext.get().partitionId()
    held: list[tuple] = []
    finished = {"number": 0}

    def block(key, b, turns, alone, first):
        count = [sum(f == k for _, f in turns) for k in (BLANK, DUPLICATE, CUT)]
        ways = {s: solve(turns, s) for s in ((START,) if first else range(4))}
        if alone:
            cost, s = last_state([w and w[:2] for w in ways[START]])
            return (key, p, b, ways[START][s][2] + TAIL[s], cost, *count, None, None, None)
        every = [ways[s][t] if s in ways else None for s in range(4) for t in range(4)]
        return (key, p, b, None, None, *count, [w and w[0] for w in every], [w and w[1] for w in every], [w and w[2] for w in every])

    key, turns, b = None, [], 0

    def close(last):
        first_here = finished["number"] == 0 and p > 0
        held.append(block(key, b, turns, alone=b == 0 and not first_here and not last, first=b == 0 and not first_here))
        finished["number"] += 1

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])
        held.clear()
        return out

    for batch in batches:
        for k, role, copies, fault, again in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "copies", "fault", "again")), strict=True):
            if k != key:
                if key is not None:
                    close(last=False)
                key, turns, b = k, [], 0
            for copy in range(copies):
                if len(turns) == BLOCK:
                    held.append(block(key, b, turns, alone=False, first=b == 0 and not (finished["number"] == 0 and p > 0)))
                    turns, b = [], b + 1
                turns.append((role[:1], fault if fault == BLANK else DUPLICATE if again or copy else fault))
        if held:
            yield flush()
    if key is not None:
        close(last=True)
        yield flush()


_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    """The picks of one open conversation from its blocks' tables."""
    part = part.sort_values(["p", "b"])
    tables = [[None if c is None or pd.isna(c) else (int(c), int(o)) for c, o in zip(costs, orders, strict=True)] for costs, orders in zip(part["costs"], part["orders"], strict=True)]
    cost, picks = chained(tables)
    tails = [""] * (len(picks) - 1) + [TAIL[picks[-1] % 4]]
    return pd.DataFrame({"key": part["key"], "p": part["p"], "b": part["b"], "pick": picks, "tail": tails, "whole": [cost] + [0] * (len(picks) - 1)})


def _edits(ready: DataFrame) -> DataFrame:
    """Blocks of edits (key, p, b, audit, cost, blank, duplicate, truncated) in the order of p and b; costs add up."""
    spark = ready.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "turn", "role", "m"]
    turns = written(_turns(ready), "flagged")
    blocks = written(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "role", "copies", "fault", "again").mapInArrow(_blocks, _PIECES), "blocks")
    fields = ["key", "p", "b", "audit", "cost", "blank", "duplicate", "truncated"]
    # tables without strings: a few hundred bytes for BLOCK turns of the conversations that end a range or have several blocks
    picks = blocks.where("audit is null").select("key", "p", "b", "costs", "orders").groupBy("key").applyInPandas(_chain, "key string, p int, b int, pick int, tail string, whole long")
    open_ = blocks.where("audit is null").drop("audit", "cost").join(small(written(picks, "picks")), ["key", "p", "b"])
    open_ = open_.withColumn("audit", F.expr("audits[pick] || tail")).withColumn("cost", F.col("whole"))
    return blocks.where("audit is not null").select(*fields).unionAll(open_.select(*fields))


def _walk(batches, turns_out: bool):
    """One pass over rows sorted by key and kind: ids (0), blocks of edits (1), turns (2)."""
    out: list[tuple] = []
    state: dict = {}

    def begin(key):
        state.clear()
        state.update(key=key, edits=[], cost=0, faults=[0, 0, 0], at=0, end=START, sha=hashlib.sha256(), any=False, before=None, low=None, high=None, distinct=0, illegal=0, audit=None)

    def put(edit, role, text):
        if turns_out:
            out.append((state["key"], state["at"], edit, role, text))
            return
        state["sha"].update((("\n" if state["any"] else "") + f"{role}:{text}").encode())
        state["any"] = True

    def inserts():
        audit = state["audit"]
        while state["at"] < len(audit) and audit[state["at"]] == "I":
            state["end"] = ONWARD[state["end"]]
            put("I", NAME[state["end"]], "")
            state["at"] += 1

    def turn(t, role, text):
        if state["audit"] is None:
            state["audit"] = "".join(state["edits"])
        inserts()
        edit = state["audit"][state["at"]]
        if edit == "R":
            state["end"] = ONWARD[state["end"]]
            put(edit, NAME[state["end"]], text)
        elif edit == "K":
            state["end"] = kept(state["end"], role[:1])
            put(edit, role, text)
        state["at"] += 1
        if state["before"] is not None and state["before"] + role[:1] not in ("su", "ua", "au"):
            state["illegal"] += 1
        state["before"] = role[:1]
        if t is not None and (state["high"] is None or t != state["high"]):
            state["low"], state["high"] = t if state["low"] is None else state["low"], t
            state["distinct"] += 1

    def finish():
        if state["audit"] is None:
            state["audit"] = "".join(state["edits"])
        inserts()
        if not turns_out:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["distinct"]
            out.append((state["key"], gaps, *state["faults"], state["illegal"], state["cost"], state["audit"], state["sha"].hexdigest()))

    types, names = (_TURNS, _TURN_NAMES) if turns_out else (_REPORT, _REPORT_NAMES)

    def flush():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return made

    for batch in batches:
        columns = [batch.column(c) for c in ("key", "kind", "audit", "cost", "blank", "duplicate", "truncated", "turn", "role", "text")]
        for key, kind, audit, cost, blank, duplicate, truncated, t, role, text in zip(*(c.to_pylist() for c in columns), strict=True):
            if not state or key != state["key"]:
                if state:
                    finish()
                begin(key)
            if kind == 1:
                state["edits"].append(audit)
                state["cost"] += cost
                state["faults"] = [x + y for x, y in zip(state["faults"], (blank, duplicate, truncated), strict=True)]
            elif kind == 2:
                turn(t, role, text)
        if out:
            yield flush()
    if state:
        finish()
    if out:
        yield flush()


_REPORT_NAMES = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_REPORT = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
_TURN_NAMES = ["key", "position", "edit", "role", "text"]
_TURNS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _walked(rows: DataFrame, ids: DataFrame | None, turns_out: bool) -> DataFrame:
    ready = _ready(rows)
    blocks = _edits(ready)
    names = {"p": "int", "b": "int", "audit": "string", "cost": "long", "blank": "long", "duplicate": "long", "truncated": "long", "turn": "long", "role": "string", "m": "binary", "text": "string"}
    shaped = lambda df, kind: df.select("key", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()))
    parts = shaped(blocks, 1).unionAll(shaped(ready, 2))
    if ids is not None:
        parts = parts.unionAll(shaped(ids.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")).distinct(), 0))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "key").sortWithinPartitions("key", "kind", "p", "b", "turn", "role", "m").drop("m", "p", "b")
    kinds = ("string", "long", "string", "string", "string") if turns_out else ("string", *["long"] * 6, "string", "string")
    out = dealt.mapInArrow(lambda batches: _walk(batches, turns_out), ", ".join(f"{n} {t}" for n, t in zip(_TURN_NAMES if turns_out else _REPORT_NAMES, kinds, strict=True)))
    return out.select(F.expr("cast(nullif(key, '') as bigint)").alias("conv_id"), *(c for c in out.columns if c != "key"))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of ``rows`` (conv_id, turn, role, text): conv_id, position (of its edit in the audit), edit, role, text.

    See ``report`` for the rules; deleted turns are left out.
    """
    return _walked(rows, None, turns_out=True)


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text), and of ``ids`` (conv_id) if given.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  conv_id and turn are integers; a null
    conv_id is a conversation of its own.  Null roles and texts are one space.  Turns come by number, nulls first, then by role and
    by the MD5 of their text; equal rows are adjacent, and all but the first of them duplicates.  Of equally cheap audits the
    ASCII-least one is taken.  Conversations of ``ids`` without rows have zeros, an empty audit and the hash of an empty string.
    Other columns are left out; no rows give no rows.

    Edits are found in blocks, whatever a conversation's length.  The digest is one hash over a conversation's texts, so these
    pass one task in order, streamed; what it holds of a conversation is its audit, a character a turn.
    """
    return _walked(rows, ids, turns_out=False)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by the CRC-32 of ``conv_id:turn`` (nulls: one space) mod 20: 0 drops a row, 1 empties its text, 2 takes
    out its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))).withColumn("k", F.crc32(name.cast("binary")) % 20).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.expr("if(k = 3, array(0, 1), array(0))")).alias("copy"))
    return out.drop("copy")
