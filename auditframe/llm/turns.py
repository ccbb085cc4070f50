"""Conversation structure repair: Wagner-Fischer alignment of turns to the strings of the grammar ``(s?(ua)+)?``.

The turns of a conversation, ordered by turn (nulls first; ties by role and a digest of the text), are aligned to every feasible
length of the alternating string ``[s]uaua...``: keep 0, rerole to user or assistant 1, delete 2, insert an empty user or assistant
turn 5, and 5 more for a truncated turn that stays.  Lengths are tried from the nearest on; each has an Ukkonen band of the diagonals
that the incumbent's cost still allows, and equal costs are decided by comparing the backtraced audits (initials of the edits).

* Blank turns, and turns whose role and text stood earlier in the conversation, must go.  As D is the least initial, their
  place never changes which alignment of the other, live turns is best, so only live turns are aligned.
* A conversation of at most ``BLOCK`` rows is one block, so its rows are repaired where its texts are met.
* Live turns of longer ones are numbered over the whole table and cut into blocks of ``BLOCK``, so a conversation may hold any share of the rows.  A
  block is aligned for every state of the grammar (nothing yet, or the last turn's initial) before and after it.  Blocks
  are combined ``FAN`` at a time, by cost and then by audit, up to the whole conversation, and the chosen states go down again.
  That is exact: two audits of equal cost over the same rows never have one as the beginning of the other.
* Equal rows are counted before they move; texts move once.

``repaired_turns`` gives the edited turns and splits freely.  ``audits`` also needs every conversation's SHA-256, a sequential
function, so its last step reads the rows of one conversation in order in one task, as a stream of constant memory but for the audit.

Nulls in conv_id, role and text count as one space, and null turns come first.  Rows without turn have no share in gaps.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.llm.common import cut_lineage, pick, table
from auditframe.operators.ordering import rank_within

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK, FAN = 32, 32
NOTHING = "0"  # state before any turn; the others are the initial of the last turn
_WHITE = r"\x20\x09-\x0D"
_LEGAL = {"su", "ua", "au"}
_FULL = {"u": "user", "a": "assistant"}
_KEY = ["conv", "has", "at", "role", "digest"]
_TABLE = "array<struct<entry:string,exit:string,cost:bigint,audit:string,path:string>>"


# ---------------------------------------------------------------- alignment


def _shift(k: int) -> int:
    """Least cost of edits that lengthen (or shorten) by k turns."""
    return INSERT * k if k > 0 else -DELETE * k


def _target(entry: str, opening: bool, length: int) -> str:
    """The initials that follow the state ``entry``, with a system turn first or not."""
    out = "s"[: int(opening)]
    while len(out) < length:
        out += "a" if (out or entry)[-1] == "u" else "u"
    return out


def wagner_fischer(turns: str, target: str, bound: int, tail: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the best alignment of cost ``bound`` or less; an upper-case turn is truncated.

    Without ``tail`` nothing is inserted after the last turn (the next block's turns take it before them).
    """
    n, m, never = len(turns), len(target), 1 << 60
    diagonals = [k for k in range(-n, m + 1) if _shift(k) + _shift(m - n - k) <= bound]
    if not diagonals:
        return None
    low, high = diagonals[0], diagonals[-1]
    # best[i][k - low + 1]: cost of aligning the turns from i with the target from i + k
    best = [[never] * (high - low + 3) for _ in range(n + 1)]

    def pair(turn: str, goal: str) -> int:
        return TRUNCATED * turn.isupper() + (0 if turn.lower() == goal else REROLE if goal in _FULL else never)

    for i in range(n, -1, -1):
        row, below = best[i], best[i + 1] if i < n else []
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            at, cost = j - i - low + 1, never
            if i == n and j == m:
                cost = 0
            if i < n:
                cost = below[at - 1] + DELETE
                if j < m:
                    cost = min(cost, below[at] + pair(turns[i], target[j]))
            if j < m and target[j] in _FULL and (tail or i < n):
                cost = min(cost, row[at + 1] + INSERT)
            row[at] = cost
    if not low <= 0 <= high or best[0][1 - low] > bound:
        return None
    i, j, audit = 0, 0, []
    while i < n or j < m:  # the least initial that keeps the cost: D, I, K, R
        at = j - i - low + 1
        cost = best[i][at]
        if i < n and best[i + 1][at - 1] + DELETE == cost:
            audit.append("D")
            i += 1
        elif j < m and target[j] in _FULL and (tail or i < n) and best[i][at + 1] + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return best[0][1 - low], "".join(audit)


@functools.lru_cache(maxsize=16)  # states that lead to the same strings ask for the same costs
def _costs(turns: str, target: str, bound: int, tail: bool) -> list[int]:
    """The least cost of aligning the turns with each beginning of the target, exact up to the bound."""
    n, m, never = len(turns), len(target), 1 << 60
    shifts = [k for k in range(-n, m + 1) if _shift(k) <= bound]
    row = [j * INSERT if (tail or n) and j <= shifts[-1] and (j == 0 or target[0] in _FULL) else never for j in range(m + 1)]
    for i, turn in enumerate(turns, 1):
        above, row, left = row, [never] * (m + 1), never
        inserts = INSERT if tail or i < n else never
        stays, letter = TRUNCATED * turn.isupper(), turn.lower()
        for j in range(max(0, i + shifts[0]), min(m, i + shifts[-1]) + 1):
            cost = above[j] + DELETE
            if j:
                goal = target[j - 1]
                if letter == goal or goal in _FULL:
                    cost = min(cost, above[j - 1] + stays + (REROLE if letter != goal else 0))
                if goal in _FULL:
                    cost = min(cost, left + inserts)
            row[j] = left = cost
    return row


@functools.lru_cache(maxsize=1 << 16)
def alignments(turns: str, entry: str = NOTHING, tail: bool = True) -> dict[str, tuple[int, str]]:
    """The best (cost, audit) from the state ``entry`` to every state that can follow.

    The costs of all lengths come from one pass; only the cheapest lengths of a state are aligned, within the band of that cost.
    """
    n, least, found = len(turns), {}, {}
    most = DELETE * n + 2 * INSERT
    tried = []
    for opening in (False, True) if entry == NOTHING else (False,):
        target = _target(entry, opening, n + most // INSERT)
        for length, cost in enumerate(_costs(turns, target, most, tail)):
            if cost <= most and (length or not opening):
                exit_ = (target[:length] or entry)[-1]
                least[exit_] = min(cost, least.get(exit_, cost))
                tried.append((exit_, cost, target[:length]))
    for exit_, cost, target in tried:
        if cost == least[exit_]:
            got = wagner_fischer(turns, target, cost, tail)
            found[exit_] = min(got, found.get(exit_, got))
    return found


def _closed(found: dict[str, tuple]) -> str:
    """The state that a whole conversation ends in."""
    return min((x for x in found if x in (NOTHING, "a")), key=lambda x: found[x][:2])


def _combined(tables: list[dict]) -> dict[tuple[str, str], tuple[int, str, str]]:
    """(entry, exit) to (cost, audit, states before each block) of blocks that follow each other."""
    done = {(e, x): (c, a, e) for (e, x), (c, a) in tables[0].items()}
    for following in tables[1:]:
        step: dict = {}
        for (e, mid), (c, a, path) in done.items():
            for (start, x), (cost, audit) in following.items():
                if start == mid and ((e, x) not in step or (c + cost, a + audit) < step[e, x][:2]):
                    step[e, x] = (c + cost, a + audit, path + mid)
        done = step
    return done


# ---------------------------------------------------------------- rows, faults and live turns


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the contract's damage by the row's checksum; rows that go have no copies."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = conversations.select(conv.alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    return rows.withColumn("kind", kind).select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _keyed(turns: DataFrame) -> DataFrame:
    text = F.col("text")
    return turns.select(
        "conv", F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("at"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text",
        (~text.rlike(f"[^{_WHITE}]")).alias("blank"), (~text.rlike(rf"[.!?][{_WHITE}]*\z")).alias("cut"),
    )


def _letter() -> Column:
    """The initial of a live turn (x for any but system, user and assistant), in upper case where it is truncated."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(F.col("cut"), F.upper(known)).otherwise(known)


def _initial(role: str, cut: bool) -> str:
    """``_letter`` of one turn."""
    known = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return known.upper() if cut else known


def _blocks(slim: DataFrame) -> DataFrame:
    """(conv, block, last, turns, rows) of the live turns of distinct rows (_KEY, copies, blank, cut)."""
    present = slim.filter("copies > 0 AND NOT blank")
    first = present.groupBy("conv", "role", "digest").agg(F.min(F.struct("has", "at")).alias("first"))
    live = present.join(first, ["conv", "role", "digest"]).filter(F.col("first") == F.struct("has", "at")).select(*_KEY, _letter().alias("letter"))
    ranked = rank_within(cut_lineage(live), ["conv"], ["has", "at", "role", "digest"], "place")
    block = F.floor((F.col("place") - 1) / BLOCK).alias("block")
    rows = ranked.groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct("place", "has", "at", "role", "digest", "letter"))).alias("rows"))
    rows = cut_lineage(rows.withColumn("turns", F.array_join(F.col("rows.letter"), "")))
    last = rows.groupBy("conv").agg(F.max("block").alias("last"))
    return rows.join(last, "conv")


# ---------------------------------------------------------------- long conversations


def _leaf_tables(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, last, turns in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)]):
                states = NOTHING if block == 0 else NOTHING + "sua"
                out.append([{"entry": e, "exit": x, "cost": c, "audit": a, "path": None} for e in states for x, (c, a) in alignments(turns, e, block == last).items()])
            kind = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["conv", "block", "states"])

    return blocks.select("conv", "block", "last", "turns").mapInArrow(run, f"conv string, block bigint, states {_TABLE}")


def _above(level: DataFrame) -> DataFrame:
    """Tables of every ``FAN`` blocks that follow each other."""

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        tables = [{(s["entry"], s["exit"]): (s["cost"], s["audit"]) for s in states} for states in rows.sort_values("block")["states"]]
        states = [{"entry": e, "exit": x, "cost": c, "audit": a, "path": p} for (e, x), (c, a, p) in _combined(tables).items()]
        return pd.DataFrame({"conv": [rows["conv"].iloc[0]], "block": [rows["parent"].iloc[0]], "states": [states]})

    parts = level.withColumn("parent", F.floor(F.col("block") / FAN))
    return parts.groupBy("conv", "parent").applyInPandas(lambda r: combine(r), f"conv string, block bigint, states {_TABLE}")


def _chosen(blocks: DataFrame) -> DataFrame:
    """(conv, block, entry, exit): the states of the best alignment around every block of conversations of several blocks."""
    levels = [cut_lineage(_leaf_tables(blocks))]
    top = blocks.agg(F.max("last")).first()[0] or 0
    while top > 0:
        levels.append(cut_lineage(_above(levels[-1])))
        top //= FAN
    ends = F.filter("states", lambda s: (s["entry"] == NOTHING) & s["exit"].isin(NOTHING, "a"))
    least = F.array_min(F.transform(ends, lambda s: F.struct(s["cost"].alias("cost"), s["audit"].alias("audit"), s["exit"].alias("exit"))))
    chosen = levels[-1].select("conv", "block", F.lit(NOTHING).alias("entry"), least["exit"].alias("exit"))
    for level, below in zip(levels[:0:-1], levels[-2::-1]):
        path = F.element_at(F.filter("states", lambda s: (s["entry"] == F.col("entry")) & (s["exit"] == F.col("exit"))), 1)["path"]
        steps = chosen.join(level, ["conv", "block"]).withColumn("path", path)
        steps = steps.select("conv", "block", "exit", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("i"))
        after = F.when(F.col("i") + 1 < F.length("path"), F.expr("substring(path, i + 2, 1)")).otherwise(F.col("exit"))
        chosen = cut_lineage(steps.select("conv", (F.col("block") * FAN + F.col("i")).alias("block"), F.expr("substring(path, i + 1, 1)").alias("entry"), after.alias("exit")))
    return chosen


# ---------------------------------------------------------------- edits


def _applied(turns: list[tuple[str, str]], audit: str, state: str) -> list[tuple[str, list[str], str | None, list[str]]]:
    """(edit, roles inserted before, role it gets, roles inserted after the last one) of every live turn (role, letter)."""
    out, before, rows = [], [], iter(turns)
    for edit in audit:
        if edit == "I":
            state = "a" if state == "u" else "u"
            before.append(_FULL[state])
            continue
        (role, letter), becomes = next(rows), None
        if edit != "D":
            state = letter.lower() if edit == "K" else "a" if state == "u" else "u"
            becomes = role if edit == "K" else _FULL[state]
        out.append((edit, before, becomes, []))
        before = []
    out[-1][3].extend(before)
    return out


def _edits(slim: DataFrame) -> DataFrame:
    """(_KEY, edit, before, becomes, after): of every live turn its edit, the roles inserted before it, its role, and those after the last turn."""
    # dealt out anew, as blocks are few bytes and much work
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut_lineage(_blocks(slim).repartition(parts, "conv", "block"))
    several = blocks.filter("last > 0")
    one = blocks.filter("last = 0").select("conv", F.lit(NOTHING).alias("entry"), F.lit(None).cast("string").alias("exit"), F.lit(True).alias("tail"), "turns", "rows")
    if several.limit(1).count():
        many = several.join(_chosen(several), ["conv", "block"]).select("conv", "entry", "exit", (F.col("block") == F.col("last")).alias("tail"), "turns", "rows")
        one = one.unionByName(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("conv", pa.string()), ("has", pa.bool_()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("edit", pa.string()), ("before", pa.list_(pa.string())), ("becomes", pa.string()), ("after", pa.list_(pa.string()))])
        for b in batches:
            out = []
            for conv, state, exit_, tail, turns, rows in zip(*[c.to_pylist() for c in b.columns]):
                found = alignments(turns, state, tail)
                edits = _applied([(row["role"], row["letter"]) for row in rows], found[exit_ or _closed(found)][1], state)
                for row, (edit, before, becomes, after) in zip(rows, edits):
                    out.append({"conv": conv, "has": row["has"], "at": row["at"], "role": row["role"], "digest": row["digest"], "edit": edit, "before": before, "becomes": becomes, "after": after})
            yield pa.RecordBatch.from_struct_array(pa.array(out, kind))

    schema = "conv string, has boolean, at bigint, role string, digest binary, edit string, before array<string>, becomes string, after array<string>"
    return cut_lineage(one.mapInArrow(run, schema))


def _slim(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.groupBy(*_KEY).agg(F.sum("copies").alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut")))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, edit, was, order): turns after repair of (conv, turn, role, text, copies).

    ``edit`` is K, R or I, ``was`` the role before; sorting a conversation by ``order`` gives its turns in place.
    """
    rows = _keyed(turns)
    edits = _edits(_slim(rows))
    texts = rows.filter("copies > 0 AND NOT blank").groupBy(*_KEY).agg(F.first("text").alias("text"))
    own = edits.filter("edit <> 'D'").join(texts, _KEY).select(*_KEY, F.col("becomes").alias("to"), "text", "edit", F.lit(1).alias("step"), F.lit(0).alias("nth"))
    added = lambda name, step: edits.select(*_KEY, F.posexplode(name).alias("nth", "to")).select(*_KEY, "to", F.lit("").alias("text"), F.lit("I").alias("edit"), F.lit(step).alias("step"), "nth")
    every = own.unionByName(added("before", 0)).unionByName(added("after", 2))
    turn = F.when(F.col("has"), F.col("at"))
    inserted = F.col("edit") == "I"
    return every.select("conv", F.when(~inserted, turn).alias("turn"), F.col("to").alias("role"), "text", "edit", F.when(~inserted, F.col("role")).alias("was"), F.struct("has", "at", "role", "digest", "step", "nth").alias("order"))


_REPORT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Report:
    """What a conversation's rows, met in order, add up to."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.hash, self.lines = conv, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = 0
        self.low = self.high = self.initial = self.pending = None
        self.after: list[str] = []

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self, roles: list[str]) -> None:
        for role in roles:
            self.line(role, "")
        self.audit.append("I" * len(roles))
        self.cost += INSERT * len(roles)

    def row(self, has: bool, at: int, role: str, copies: int, blank: bool, cut: bool, edit: str | None, before: list[str] | None, becomes: str | None, after: list[str] | None) -> None:
        self.pending = None
        if not copies:
            return
        if has:
            self.distinct += at != self.high
            self.low, self.high = at if self.low is None else self.low, at
        initial = role[:1]
        self.illegal += (copies - 1) + (self.initial is not None and self.initial + initial not in _LEGAL)
        self.initial = initial
        gone = copies
        if edit is None:
            self.blank += copies * blank
            self.duplicate += copies * (not blank)
        else:
            self.duplicate += copies - 1
            self.truncated += cut
            self.insert(before)
            self.after = after or self.after
            gone = copies - 1 + (edit == "D")
            if edit != "D":
                self.audit.append(edit)
                self.cost += REROLE * (edit == "R") + TRUNCATED * cut
                self.pending = becomes
        self.audit.append("D" * gone)
        self.cost += DELETE * gone

    def text(self, text: str) -> None:
        """The text of the row before; equal rows bring theirs again."""
        if self.pending is not None:
            self.line(self.pending, text)
            self.pending = None

    def done(self) -> tuple:
        self.insert(self.after)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _long_audits(turns: DataFrame) -> DataFrame:
    """Reports of conversations of any length."""
    rows = _keyed(turns)
    slim = _slim(rows)
    marks = slim.join(_edits(slim), _KEY, "left").select(*_KEY, F.lit(0).alias("kind"), "copies", "blank", "cut", "edit", "before", "becomes", "after", F.lit(None).cast("string").alias("text"))
    empty = {"copies": "bigint", "blank": "boolean", "cut": "boolean", "edit": "string", "before": "array<string>", "becomes": "string", "after": "array<string>"}
    texts = rows.filter("copies > 0 AND NOT blank").select(*_KEY, F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "text")
    ordered = marks.unionByName(texts).repartition("conv").sortWithinPartitions(*_KEY, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _REPORT.split(", ")]
        now = None
        for b in batches:
            done = []
            for conv, has, at, role, _, kind, *marks, text in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.done())
                    now = _Report(conv)
                if kind:
                    now.text(text)
                else:
                    now.row(has, at, role, *marks)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in now.done()], names=names)

    return ordered.mapInArrow(run, _REPORT)


def _short_report(conv: str, rows: list[tuple]) -> tuple:
    """The report of a conversation of one block from its rows (_KEY without conv, copies, blank, cut, text) in order."""
    distinct: list[list] = []
    for row in rows:
        if distinct and distinct[-1][:4] == list(row[:4]):
            distinct[-1][4] += row[4]
        else:
            distinct.append(list(row))
    first: dict = {}
    for place, (_, _, role, digest, copies, blank, _, _) in enumerate(distinct):
        if copies and not blank:
            first.setdefault((role, digest), place)
    live = {place: (distinct[place][2], _initial(distinct[place][2], distinct[place][6])) for place in first.values()}
    edits = {}
    if live:
        found = alignments("".join(letter for _, letter in live.values()))
        edits = dict(zip(live, _applied(list(live.values()), found[_closed(found)][1], NOTHING)))
    report = _Report(conv)
    for place, (has, at, role, _, copies, blank, cut, text) in enumerate(distinct):
        report.row(has, at, role, copies, blank, cut, *edits.get(place, (None,) * 4))
        report.text(text)
    return report.done()


def _short_audits(turns: DataFrame) -> DataFrame:
    """Reports of conversations of at most ``BLOCK`` rows: each is met in order and repaired as one block."""
    ordered = _keyed(turns).select(*_KEY, "copies", "blank", "cut", "text").repartition("conv").sortWithinPartitions(*_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _REPORT.split(", ")]
        now, rows = None, []
        for b in batches:
            done = []
            for conv, *row in zip(*[c.to_pylist() for c in b.columns]):
                if conv != now:
                    if rows:
                        done.append(_short_report(now, rows))
                    now, rows = conv, []
                rows.append(tuple(row))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _short_report(now, rows)], names=names)

    return ordered.mapInArrow(run, _REPORT)


def audits(turns: DataFrame) -> DataFrame:
    """One report a conversation of (conv, turn, role, text, copies): faults, cost, audit and the digest of its repaired text.

    Only conversations of more than one block are numbered, cut and combined; for the others their texts move once and nothing is written.
    """
    long = cut_lineage(turns.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("conv"))
    short = _short_audits(turns.join(long, "conv", "left_anti"))
    if not long.limit(1).count():
        return short
    return short.unionByName(_long_audits(turns.join(long, "conv", "left_semi")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    found = audits(damaged(rows))
    return found.select(F.when(F.col("conv") != " ", F.col("conv").cast("bigint")).alias("conv_id"), *[c.split(" ")[0] for c in _REPORT.split(", ")[1:]])


QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLES: dict[str, str] = {}
