"""Conversation structure repair: the cheapest edits that give a well-formed dialogue.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its rows are dealt by
conversation, sorted by turn, and streamed once: a dynamic program over the four states of
that pattern is carried from Arrow batch to Arrow batch. For each state it holds the least
cost, the rank of the state's edit string among all four (so ties go to the ASCII-least
string without keeping the strings), and a running SHA-256 of the repaired text. What a
state chose at a row is one byte; four bytes a row are kept for the way back, in memory up
to ``SPILL`` bytes and beyond that in an unnamed file that ends with the task. So a giant
conversation costs its task four bytes a row, and its texts are never held.

Why ranks suffice: an edit string is cut after each row's own edit (inserts belong to the
row they precede). Two different strings up to the same row end in a row edit and hold
equally many of them, so neither is a prefix of the other, and their order is settled.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import has_word, pinned

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
SPILL = 16 << 20
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_EXPECTED = ("u", "u", "a", "u")  # the initial that may follow a state (a system turn only at the start)
_AFTER = {"u": _USER, "a": _ASSISTANT}
_ROLE = {"u": "user", "a": "assistant"}
_OPS = "DKR"

REPORT = ("conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
EDITS = "conv string, place bigint, before int, edit string, new_role string"


def _moves(initial: str, doomed: bool, unfinished: bool) -> list[list[tuple[int, int, str, int]]]:
    """For each next state the ways there over one row: (state before, cost, letters, code).

    At most one way for each pair of states: the cheapest, then the ASCII-least. ``code``
    packs state before, number of inserts and row edit into one byte.
    """
    best: dict[tuple[int, int], tuple[int, str, int]] = {}

    def offer(before: int, after: int, cost: int, letters: str, inserts: int) -> None:
        way = (cost, letters, before | inserts << 2 | _OPS.index(letters[-1]) << 4)
        best[before, after] = min(best.get((before, after), way), way)

    for before in range(4):
        offer(before, before, DELETE, "D", 0)
        if doomed:
            continue
        extra = UNFINISHED if unfinished else 0
        state = before
        for inserts in range(3):  # two reach every state; more only go round
            paid, letters = inserts * INSERT + extra, "I" * inserts
            wanted = _EXPECTED[state]
            offer(before, _AFTER[wanted], paid + REROLE, letters + "R", inserts)
            if initial == wanted:
                offer(before, _AFTER[wanted], paid + KEEP, letters + "K", inserts)
            if initial == "s" and state == _START:
                offer(before, _SYSTEM, paid + KEEP, letters + "K", inserts)
            state = _AFTER[wanted]
    return [[(b, *best[b, a]) for b in range(4) if (b, a) in best] for a in range(4)]


_MOVES = {(i, d, u): _moves(i, d, u) for i in ("s", "u", "a", "") for d in (False, True) for u in (False, True)}


def _inserted(state: int, inserts: int) -> tuple[list[bytes], int]:
    """Lines of the inserted turns after ``state`` and the state they lead to."""
    lines = []
    for _ in range(inserts):
        wanted = _EXPECTED[state]
        lines.append(f"{_ROLE[wanted]}:".encode())
        state = _AFTER[wanted]
    return lines, state


class _Conversation:
    """The program's state for one conversation, fed row by row in order."""

    def __init__(self, conv: str | None):
        self.conv = conv
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.sha = [hashlib.sha256(), None, None, None]
        self.back, self.file, self.rows = bytearray(), None, 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.before = self.initial = None

    def feed(self, turn: str | None, role: str, text: str, fault: int) -> None:
        row = (turn, role, text)
        if fault != 1 and row == self.before:  # equal rows are neighbours in the order
            fault = 2
        self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = self.first_turn or turn
            self.last_turn = turn
        initial = role[:1]
        if self.before is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before, self.initial = row, initial

        moves = _MOVES[initial if initial in ("s", "u", "a") else "", fault in (1, 2), fault == 3]
        cost, rank = self.cost, self.rank
        chosen = []
        for ways in moves:
            picked = None
            for before, paid, letters, code in ways:
                if cost[before] is not None:
                    way = (cost[before] + paid, rank[before], letters, code)
                    if picked is None or way < picked:
                        picked = way
            chosen.append(picked)
        alive = sorted((p[1], p[2], s) for s, p in enumerate(chosen) if p is not None)
        self.rank = [0, 0, 0, 0]
        for r, (_, _, s) in enumerate(alive):
            self.rank[s] = r
        self.cost = [p and p[0] for p in chosen]
        self.back += bytes(p[3] if p else 0 for p in chosen)
        if len(self.back) >= SPILL:
            self.file = self.file or tempfile.TemporaryFile()  # no name, gone with the task
            self.file.write(self.back)
            self.back = bytearray()
        self.rows += 1

        shas = []
        for state, p in enumerate(chosen):
            if p is None:
                shas.append(None)
                continue
            before, inserts, op = p[3] & 3, p[3] >> 2 & 3, _OPS[p[3] >> 4]
            sha = self.sha[before]
            if op != "D":
                lines, at = _inserted(before, inserts)
                name = role if op == "K" else _ROLE[_EXPECTED[at]]
                lines.append(name.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
                sha = sha.copy()
                sha.update((b"" if before == _START else b"\n") + b"\n".join(lines))
            shas.append(sha)
        self.sha = shas

    def _end(self) -> tuple[int, int, int]:
        """(cost, final state, inserts at the end) of the best well-formed whole."""
        ways = []
        for state, inserts in ((_START, 0), (_ASSISTANT, 0), (_USER, 1), (_SYSTEM, 2)):
            if self.cost[state] is not None:
                ways.append((self.cost[state] + inserts * INSERT, self.rank[state], inserts, state))
        cost, _, inserts, state = min(ways)
        return cost, state, inserts

    def choices(self) -> Iterator[tuple[int, int, str, str | None]]:
        """The best edits, last row first: (row, inserts before it, edit, new role)."""
        _, state, _ = self._end()
        block, start = self.back, self.rows - len(self.back) // 4
        for row in range(self.rows - 1, -1, -1):
            if row < start:
                start -= SPILL // 4
                self.file.seek(start * 4)
                block = self.file.read(SPILL)
            code = block[(row - start) * 4 + state]
            before, inserts, op = code & 3, code >> 2 & 3, _OPS[code >> 4]
            new = None
            if op == "R":
                new = _ROLE[_EXPECTED[_inserted(before, inserts)[1]]]
            yield row, inserts, op, new
            state = before

    def report(self) -> tuple:
        cost, state, inserts = self._end()
        letters = ["I" * inserts]
        letters += [op + "I" * before for _, before, op, _ in self.choices()]  # written back to front
        sha = self.sha[state].copy()
        if inserts:
            sha.update(b"\n" + b"\n".join(_inserted(state, inserts)[0]))
        gaps = int(self.last_turn) - int(self.first_turn) + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, cost, "".join(letters)[::-1], sha.hexdigest())

    def edits(self) -> Iterator[tuple]:
        _, state, inserts = self._end()
        if inserts:
            yield self.conv, self.rows + 1, inserts, None, None
        for row, before, op, new in self.choices():
            yield self.conv, row + 1, before, op, new

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _stream(batches: Iterator[pd.DataFrame], edits: bool, out_rows: int = 4096) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in (EDITS if edits else REPORT).split(", ")]
    held: _Conversation | None = None
    out: list[tuple] = []

    def finish() -> Iterator[pd.DataFrame]:
        for row in held.edits() if edits else [held.report()]:
            out.append(row)
            if len(out) >= out_rows or row[7:] and len(row[7]) > SPILL:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        held.close()

    for batch in batches:
        for conv, turn, role, text, fault, present in zip(*(batch[c] for c in ("conv", "turn", "role", "text", "fault", "present"))):
            if held is None or conv != held.conv:
                if held is not None:
                    yield from finish()
                held = _Conversation(conv)
            if present:
                held.feed(turn, role, text, fault)
    if held is not None:
        yield from finish()
    if out:
        yield pd.DataFrame(out, columns=columns)


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Narrow rows with their first fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    narrow = rows.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"))
    own = F.concat(F.coalesce(F.concat(F.lit("="), "conv"), F.lit("-")), F.lit("\n"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    keyed = narrow.withColumn("digest", F.md5(own))
    # the first turn of every repeated (conversation, role, text): combined before the shuffle
    firsts = (keyed.where("present").groupBy("digest")
              .agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unplaced"))
              .where("n > 1").select("digest", "first", "unplaced"))
    later = F.col("turn").isNotNull() & F.coalesce(F.col("unplaced") | (F.col("turn") > F.col("first")), F.lit(False))
    done = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~has_word(F.col("text")), 1).when(later, 2).when(~done, 3).otherwise(0)
    return keyed.join(firsts, "digest", "left").select("conv", "turn", "role", "text", "present", fault.alias("fault"))


_ORDER = ("conv", "turn", "role", "text")  # nulls first, so rows without a turn lead


def _run(ordered: DataFrame, edits: bool) -> DataFrame:
    dealt = ordered.repartition("conv").sortWithinPartitions(*_ORDER).withColumn("turn", F.col("turn").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a missing string may arrive as None or NaN
        clean = (b.assign(**{c: b[c].astype(object).where(b[c].notna(), None) for c in ("conv", "turn")}) for b in batches)
        yield from _stream(clean, edits)

    return dealt.mapInPandas(run, EDITS if edits else REPORT)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """One row for each conversation: faults, cheapest edits and digest of the repaired text.

    Rows of a conversation are taken by turn (null turns first), then role, then text. A
    row's first fault counts: blank (no character but white space), duplicate (role and text
    seen earlier), truncated (last other character not ``.``, ``!`` or ``?``). Edits: Keep 0;
    Rerole to the role that may follow 3; Delete 4 (required for blank and duplicate rows);
    Insert an empty user or assistant turn anywhere 3; a truncated row that stays adds 3.
    ``audit`` is the cheapest edits' initials (ASCII-least of equals), ``repaired_sha256`` the
    digest of the repaired ``role:text`` lines joined by newlines.

    Null roles and texts count as one space; rows without a conversation id form one
    conversation; roles outside system, user and assistant (also empty ones) cannot be kept.
    Repeated rows are duplicates. ``present`` names a boolean column: rows where it is not
    true are not part of their conversation but keep its id in the result, so a conversation
    without rows gives zeros, an empty audit and the digest of nothing. Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    kind = rows.schema[conv].dataType
    return _run(_ordered(rows, conv, turn, role, text, present), False).withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   present: str | None = None) -> DataFrame:
    """The repaired conversations themselves: (conv, place, step, edit, role, text), in the order (place, step).

    ``place`` is the row of the conversation that a turn stems from or precedes, ``step``
    orders inserted turns before it; ``edit`` is K, R or I. Deleted rows are gone. Same rules as
    ``repair``. The edits leave the stream as rows and meet the texts by (conversation, place),
    so a giant conversation is written by many tasks.
    """
    from shelfspark.plans.windows import running_count

    ordered = pinned(_ordered(rows, conv, turn, role, text, present).where("present"))
    placed = running_count(ordered.select("conv", "turn", "role", "text"), [F.col(c).asc() for c in _ORDER[1:]], ["conv"], out="place")
    edits = pinned(_run(ordered, True))
    named = edits.withColumnsRenamed({"conv": "_conv", "place": "_place"})
    met = named.join(placed, F.col("_conv").eqNullSafe(F.col("conv")) & (F.col("_place") == F.col("place")), "left")
    # roles of inserted turns alternate up to the row's own new role, or close the conversation
    own_role = F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role"))
    goal = F.when(F.col("edit").isNull(), F.lit("u")).otherwise(F.substring(own_role, 1, 1))
    steps = F.transform(F.sequence(F.lit(1), F.col("before")), lambda s: F.struct(
        s.alias("step"), F.lit("I").alias("edit"),
        F.when(((F.col("before") - s) % 2 == 0) == (goal == "u"), F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.lit("").alias("text")))
    inserted = F.when(F.col("before") > 0, steps).otherwise(F.array().cast("array<struct<step:int,edit:string,role:string,text:string>>"))
    stays = F.coalesce(F.col("edit") != "D", F.lit(False))
    row = F.array(F.struct((F.col("before") + 1).alias("step"), F.col("edit"), own_role.alias("role"), F.col("text")))
    turns = F.when(stays, F.concat(inserted, row)).otherwise(inserted)
    kind = rows.schema[conv].dataType
    return met.select(F.col("_conv").cast(kind).alias(conv), F.col("_place").alias("place"), F.inline(turns))
