"""Conversation structure repair: cheapest edits that turn a conversation into an optional system turn and user-assistant pairs.

Conversations are dealt by ``conv_id`` and sorted within their partition by falling turn; ``mapInPandas`` walks the rows once and carries, for each state of the role automaton, the cost of
repairing all later rows, across Arrow batches. A row leaves one byte of backpointers, two bits a state. When a conversation's first turn has come, the backpointers are followed from its first row on, which
gives the edits in order; of equally cheap edits the least character comes first at each place, so the whole sequence is the least. Rows of a conversation wait with their backpointers in blocks of
``BLOCK`` characters; full blocks go to an unnamed spill file of the task attempt, as a sort's spills do, so a giant conversation takes the memory of one block. A lost task starts anew.
What is earlier in a conversation (duplicates) is counted by a window of the same shuffle.

Rows of one conversation follow by turn (null first), then role and text. Defined results: a null role or text is one space; an empty role has no initial; null ``conv_id`` is a conversation of its own; repeated rows are duplicates of
the first; an empty table gives no rows; further columns don't matter. All rows of a conversation meet in one task, as a hash over its whole text must read it in order; the task streams.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Costs of the edits; a truncated row that stays adds ``TRUNCATED``.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Characters of a conversation that wait in memory, and rows of a result frame.
BLOCK, FRAME = 8_000_000, 4_000

# States: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and the last may end.
FOLLOW = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS, NEXT_ROLE, NEXT_STATE = (0, 3), ("u", "u", "a", "u"), (2, 2, 3, 2)
ROLE = {"u": "user", "a": "assistant"}
EDITS = "DIKR"  # in ASCII order
FAR = 1 << 30


def _after(state: int, initial: str) -> int | None:
    """The state after a kept row; a row with an empty role has no initial and changes nothing."""
    return FOLLOW.get((state, initial)) if initial else state


def fault(text: Column, nth: Column) -> Column:
    """The first fault: ``blank``, ``duplicate`` (``nth`` of its role and text over 1), ``truncated``, or none."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(nth > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


@functools.cache
def step(later: tuple[int, ...], initial: str | None, faulty: str) -> tuple[tuple[int, ...], int, int]:
    """Costs by state before a row from those after it: less their minimum, the minimum, and the byte of choices. ``initial`` None: the end, where nothing is left but insertions."""
    best, costs = [], [dict() for _ in range(4)]
    for s in range(4):
        if initial is None:
            costs[s] = {"K": 0 if s in ENDS else FAR}
        else:
            more = TRUNCATED if faulty == "truncated" else 0
            costs[s] = {"D": DELETE + later[s]}
            if faulty not in ("blank", "duplicate"):
                costs[s]["R"] = REROLE + more + later[NEXT_STATE[s]]
                if (kept := _after(s, initial)) is not None:
                    costs[s]["K"] = KEEP + more + later[kept]
        best.append(min(costs[s].values()))
    for _ in range(3):  # at most three insertions in a row
        best = [min(best[s], INSERT + best[NEXT_STATE[s]]) for s in range(4)]
    choices = 0
    for s in range(4):
        costs[s]["I"] = INSERT + best[NEXT_STATE[s]]
        choices |= next(k for k, e in enumerate(EDITS) if costs[s].get(e) == best[s]) << 2 * s
    least = min(best)
    return tuple(b - least for b in best), least, choices


class _Backlog:
    """Rows of one conversation, last one in first out; all but the last block in the spill file."""

    def __init__(self):
        self.rows, self.size, self.blocks, self.spill = [], 0, [], None

    def push(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size
        if self.size > BLOCK:
            self.spill = self.spill or tempfile.TemporaryFile()
            self.blocks.append(self.spill.tell())
            pickle.dump(self.rows, self.spill, pickle.HIGHEST_PROTOCOL)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        yield from reversed(self.rows)
        for at in reversed(self.blocks):
            self.spill.seek(at)
            self.rows = pickle.load(self.spill)
            yield from reversed(self.rows)
        if self.spill:
            self.spill.close()


COLUMNS = "conv string, seq long, edit string, cost long, fault string, turn string, old_role string, role string, text string"


def _edits(conv: str | None, backlog: _Backlog, end: int) -> Iterator[tuple]:
    """The edits in order, as rows of ``COLUMNS``; a conversation without rows gives one row without edit."""
    state, seq = 0, 0
    some = False

    def insert():
        nonlocal state, seq
        row = (conv, seq, "I", INSERT, "", None, None, ROLE[NEXT_ROLE[state]], "")
        state, seq = NEXT_STATE[state], seq + 1
        return row

    for choices, turn, role, text, faulty in backlog:
        some = True
        while (edit := EDITS[choices >> 2 * state & 3]) == "I":
            yield insert()
        more = TRUNCATED if faulty == "truncated" else 0
        if edit == "D":
            yield conv, seq, edit, DELETE, faulty, turn, role, None, None
        elif edit == "K":
            yield conv, seq, edit, KEEP + more, faulty, turn, role, role, text
            state = _after(state, role[:1])
        else:
            yield conv, seq, edit, REROLE + more, faulty, turn, role, ROLE[NEXT_ROLE[state]], text
            state = NEXT_STATE[state]
        seq += 1
    while EDITS[end >> 2 * state & 3] == "I":
        some = True
        yield insert()
    if not some:
        yield conv, 0, None, 0, None, None, None, None, None


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows sorted by conversation and falling turn to edits in order."""
    start, _, end = step((0, 0, 0, 0), None, "")
    now, later, backlog = None, start, None
    for frame in frames:
        for conv, lost, turn, role, text, faulty in zip(*(frame[c].tolist() for c in ("conv", "lost", "turn", "role", "text", "fault")), strict=True):
            if backlog is None or conv != now:
                if backlog is not None:
                    yield from _edits(now, backlog, end)
                now, later, backlog = conv, start, _Backlog()
            if not lost:
                later, _, choices = step(later, role[:1], faulty)
                backlog.push((choices, turn, role, text, faulty), len(text) + 100)
    if backlog is not None:
        yield from _edits(now, backlog, end)


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out, size = [], 0
    for row in _walk(frames):
        out.append(row)
        size += 1 + len(row[-1] or "") // 1000
        if size >= FRAME:
            yield pd.DataFrame(out, columns=names)
            out, size = [], 0
    yield pd.DataFrame(out, columns=names)


def _ordered_edits(rows: DataFrame) -> DataFrame:
    """``COLUMNS`` from ``conv_id, turn, role, text`` and ``lost`` (a row that only names its conversation). A conversation's edits follow each other in a partition."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    dealt = rows.select(F.col("conv_id").cast("string").alias("conv"), "turn", text("role"), text("text"), "lost").repartition("conv")
    same = W.partitionBy("conv", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    judged = dealt.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault(F.col("text"), F.col("nth")))
    falling = judged.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("nth").desc())
    return falling.select("conv", "lost", F.col("turn").cast("string").alias("turn"), "role", "text", "fault").mapInPandas(_stream, COLUMNS)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation, a row each: ``conv_id, seq`` (from 0), ``edit`` (Keep, Rerole, Delete or Insert by initial), ``cost, fault, turn, old_role``, and the repaired ``role`` and
    ``text`` (null for a deleted row). The rows with a role, by ``seq``, are the repaired conversation."""
    kinds = rows.schema
    out = _ordered_edits(rows.withColumn("lost", F.lit(False)))
    return out.where("edit is not null").select(F.col("conv").cast(kinds["conv_id"].dataType).alias("conv_id"), "seq", "edit", "cost", "fault", F.col("turn").cast(kinds["turn"].dataType).alias("turn"), "old_role", "role", "text")


DIGEST = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest:
    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.cost, self.empty = conv, hashlib.sha256(), bytearray(), 0, True
        self.faults, self.illegal, self.before = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, edit, cost, faulty, turn, old, role, text):
        if edit is None:
            return
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            if faulty:
                self.faults[faulty] += 1
            if self.before is not None and self.before + old[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = old[:1]
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if role is not None:
            self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self):
        gaps = int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    now = None
    for frame in frames:
        out = []
        for conv, edit, cost, faulty, turn, old, role, text in zip(*(frame[c].tolist() for c in ("conv", "edit", "cost", "fault", "turn", "old_role", "role", "text")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Digest(conv)
            now.add(edit, cost, faulty, turn, old, role, text)
        yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


def repair_report(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (``conv_id, turn`` (a whole number)``, role, text, lost``): counts of gaps and faults, illegal neighbours, the cost, the edits as a string, and the hash of the repaired text.

    Rows that are ``lost`` count for nothing but their conversation's name. The digests read the edits in the partitions and the order in which ``repair`` makes them."""
    return _ordered_edits(rows).mapInPandas(_digests, DIGEST).select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *(c.split()[0] for c in DIGEST.split(", ")[1:]))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted damage by a hash of conversation and turn: lost, emptied, cut short, repeated or with another role."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(one("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    return repair_report(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
