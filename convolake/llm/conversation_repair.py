"""Conversation structure repair by generalised LR parsing with edits.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: an
optional system turn, then user and assistant by turns, or nothing.  The role
grammar is compiled to an SLR table, and all cheapest ways to edit the turns
into a sentence of it are followed at once on a graph-structured stack:

==========  ====  =======================================================
edit        cost
==========  ====  =======================================================
K(eep)      0     the turn stays as it is
R(erole)    3     its role becomes user or assistant
D(elete)    4     the turn goes; required for blank and duplicate turns
I(nsert)    3     an empty user or assistant turn, anywhere
==========  ====  =======================================================

A truncated turn that is not deleted costs 3 more.  After each turn, stacks with
an equal top are merged into the one with the least (cost, audit), where the
audit is the string of edits; what may follow depends on the top alone in this
grammar, so nothing is lost.  Of two audits of one cost that consume the same
turns and end with a turn, neither is a prefix of the other; the order of old
audits therefore decides that of new ones, and no audit is copied on the way.

Each turn has one fault at most, the first of: ``blank`` (no character but
blanks and ``\\t..\\r``), ``duplicate`` (role and text occurred earlier in the
conversation), ``truncated`` (the last character that is no blank is none of
``.!?``).

Turns are read in the order of ``turn_order.in_ranges``.  A conversation that
lies in one range is parsed at once.  For pieces of others a task parses its
piece from every stack that may stand before it (the grammar has ten), and
the pieces are composed afterwards; texts never meet in one task.

Defined cases: a null id is a conversation of its own, null turns come first and
do not count for gaps, a null role or text is one blank.  A role is judged by
its first character; a role that starts with none of s, u, a (or is empty) can
only be reroled or deleted.  Repeated rows are repeats of a turn: duplicates, or
blanks.  Turns of one number stand by role and text.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import staged
from convolake.llm.turn_order import by_conversation, in_ranges, part_id, ranges_for, rows_of

RULES = (("S", ""), ("S", "sB"), ("S", "B"), ("B", "ua"), ("B", "Bua"))
ROLE = {"s": "system", "u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
BLANKS = " \t\n\x0b\f\r"
#: a piece of a conversation that is held at once
SEGMENT_ROWS, SEGMENT_CHARS = 20_000, 4_000_000


# ---------------------------------------------------------------- the parser

class LrTable:
    """SLR(1) shifts, gotos and reductions of a grammar whose symbols are
    single characters (capitals: nonterminals; the first rule names the start)."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = rules
        self.start = rules[0][0]
        self.follow = self._follow()
        states = [self._closure({(i, 0) for i, r in enumerate(rules) if r[0] == self.start})]
        self.goto: dict[tuple[int, str], int] = {}
        for at, items in enumerate(states):  # grows while it is read
            for symbol in sorted({rules[r][1][dot] for r, dot in items if dot < len(rules[r][1])}):
                moved = self._closure({(r, dot + 1) for r, dot in items if rules[r][1][dot:dot + 1] == symbol})
                if moved not in states:
                    states.append(moved)
                self.goto[at, symbol] = states.index(moved)
        self.reduces = [[rules[r] for r, dot in sorted(items) if dot == len(rules[r][1])] for items in states]

    def _closure(self, items: set) -> frozenset:
        items = set(items)
        while True:
            wanted = {self.rules[r][1][dot] for r, dot in items if dot < len(self.rules[r][1])}
            more = {(i, 0) for i, rule in enumerate(self.rules) if rule[0] in wanted}
            if more <= items:
                return frozenset(items)
            items |= more

    def _follow(self) -> dict[str, set]:
        """What may stand after a nonterminal ('$': the end).  Only the start
        symbol may be empty, and no rule uses it, so first symbols suffice."""
        follow = {left: set() for left, _ in self.rules}
        follow[self.start].add("$")
        first = {left: {r[0] for l, r in self.rules if l == left and r and not r[0].isupper()} for left in follow}
        for _ in self.rules:
            for left, right in self.rules:
                if right and right[0].isupper():
                    first[left] |= first[right[0]]
                for x, y in zip(right, right[1:] + "$"):
                    if x.isupper():
                        follow[x] |= follow[left] if y == "$" else first[y] if y.isupper() else {y}
        return follow


TABLE = LrTable(RULES)
#: a stack is (state, stack below); equal lower parts are shared
ROOT = (0, None)


def _reduced(stack, ahead: str) -> list:
    """The stack and all stacks that reductions before ``ahead`` lead to."""
    found = [stack]
    for top in found:  # grows while it is read
        for left, right in TABLE.reduces[top[0]]:
            below = top
            for _ in right:
                below = below[1]
            if ahead in TABLE.follow[left] and (below[0], left) in TABLE.goto:
                found.append((TABLE.goto[below[0], left], below))
    return found


def _shift(stack, symbol: str) -> list:
    return [(TABLE.goto[s[0], symbol], s) for s in _reduced(stack, symbol) if (s[0], symbol) in TABLE.goto]


def _accepts(stack) -> bool:
    """Whether the reductions before the end reach the start symbol alone."""
    for top in _reduced(stack, "$"):
        for left, right in TABLE.reduces[top[0]]:
            below = top
            for _ in right:
                below = below[1]
            if left == TABLE.start and below == ROOT:
                return True
    return False


def _inserted(stack) -> list:
    """Stacks after inserts only: ``(stack, roles)``, the fewest inserts each."""
    seen, found = {stack[0]}, [(stack, "")]
    for at, roles in found:  # grows while it is read
        for role in "ua":
            for new in _shift(at, role):
                if new[0] not in seen:
                    seen.add(new[0])
                    found.append((new, roles + role))
    return found


@functools.cache
def steps(stack, initial: str, must_go: bool, truncated: bool) -> list:
    """``(new stack, cost, edits, roles)`` for one turn, inserts before it
    included, the least per top; ``roles`` names those of I and R edits."""
    found: dict[int, tuple] = {}

    def offer(new, cost, edits, roles):
        if new[0] not in found or (cost, edits) < found[new[0]][1:3]:
            found[new[0]] = (new, cost, edits, roles)

    late = TRUNCATED * truncated
    for at, roles in _inserted(stack):
        cost, edits = INSERT * len(roles), "I" * len(roles)
        offer(at, cost + DELETE, edits + "D", roles + "-")
        if must_go:
            continue
        if initial in ROLE:
            for new in _shift(at, initial):
                offer(new, cost + late, edits + "K", roles + "-")
        for role in "ua":
            for new in _shift(at, role):
                offer(new, cost + REROLE + late, edits + "R", roles + role)
    return list(found.values())


@functools.cache
def finish(stack) -> tuple[int, str, str] | None:
    """Cost, edits and roles of the inserts that end a conversation here."""
    ends = [(INSERT * len(roles), "I" * len(roles), roles) for at, roles in _inserted(stack) if _accepts(at)]
    return min(ends) if ends else None


@functools.cache
def all_stacks() -> list:
    """Every stack that can stand before a turn."""
    found = [ROOT]
    for at in found:  # grows while it is read
        found += [new for role in ROLE for new in _shift(at, role) if new not in found]
    return found


class Parse:
    """The graph-structured stack over the turns seen since ``entry``.  A head is
    ``(cost, order of its audit, stack, trail)``; trails share their beginnings."""

    def __init__(self, entry=ROOT):
        self.heads = [(0, 0, entry, None)]

    def turn(self, initial: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        for cost, order, stack, trail in self.heads:
            for new, more, edits, roles in steps(stack, initial, must_go, truncated):
                key = (cost + more, order, edits)
                if new[0] not in best or key < best[new[0]][0]:
                    best[new[0]] = (key, new, (trail, edits, roles))
        self._rank(best.values())

    def piece(self, exits: dict) -> None:
        """Goes on over a piece parsed from every stack: ``exits`` has, by entry,
        ``(exit, cost, edits, roles)``."""
        best: dict[int, tuple] = {}
        for cost, order, stack, trail in self.heads:
            for new, more, edits, roles in exits[all_stacks().index(stack)]:
                key = (cost + more, order, edits)
                new = all_stacks()[new]
                if new[0] not in best or key < best[new[0]][0]:
                    best[new[0]] = (key, new, (trail, edits, roles))
        self._rank(best.values())

    def _rank(self, found) -> None:
        found = list(found)
        place = {k: i for i, k in enumerate(sorted({key[1:] for key, _, _ in found}))}  # equal audits, equal order
        self.heads = [(key[0], place[key[1:]], new, trail) for key, new, trail in found]

    @staticmethod
    def written(trail) -> list[tuple[str, str]]:
        """(edits, roles) of each step of a trail, in order."""
        out = []
        while trail is not None:
            trail, edits, roles = trail
            out.append((edits, roles))
        return out[::-1]

    def best(self) -> tuple[int, list[tuple[str, str]]]:
        """Least cost and the steps of its least audit."""
        ends = []
        for cost, order, stack, trail in self.heads:
            end = finish(stack)
            if end is not None:
                ends.append((cost + end[0], order, end, trail))
        cost, _, end, trail = min(ends, key=lambda x: (x[0], x[1], x[2][1]))
        return cost, [*self.written(trail), (end[1], end[2])]


def apply_edits(edits: str, roles: str, turns) -> list[dict]:
    """The repaired turns; deleted ones are left out."""
    out, turns = [], iter(turns)
    for edit, role in zip(edits, roles):
        if edit == "I":
            out.append({"edit": edit, "role": ROLE[role], "text": ""})
            continue
        old, text = next(turns)
        if edit != "D":
            out.append({"edit": edit, "role": ROLE[role] if edit == "R" else old, "text": text})
    return out


# ---------------------------------------------------------------- on Spark

_TURNS = "array<struct<edit:string,role:string,text:string>>"


def mark_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (``conv_id, turn, role, text, lost``) with ``blank``, ``later``
    (role and text stand under a smaller turn, too) and ``cut``."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = (rows.withColumn("blank", bare == "").withColumn("cut", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
            .withColumn("digest", F.sha2(F.col("text"), 256)).withColumn("place", F.struct(F.col("turn").isNotNull(), F.col("turn"))))
    seen = (rows.where("not lost and not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
            .agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last"))
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("conv_id", "turn", "role", "text", "lost", "blank", "cut",
                         F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("later"))


class _Piece:
    """What a task knows of one conversation, or of a part of it."""

    def __init__(self, conv, whole: bool):
        self.conv, self.whole = conv, whole
        self.parses = [Parse()] if whole else [Parse(s) for s in all_stacks()]
        self.turns, self.chars = [], 0
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = self.before = None

    def add(self, turn, role, text, blank, cut, later):
        same = (turn, role, text)
        repeat = later or self.before == same
        self.before = same
        fault = "blank" if blank else "duplicate" if repeat else "truncated" if cut else None
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.last_role = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.count["distinct"] += 1
            self.last_turn = turn
        for parse in self.parses:
            parse.turn(initial, fault in ("blank", "duplicate"), fault == "truncated")
        self.turns.append((role, text))
        self.chars += len(text)

    def row(self, part: int, seq: int) -> dict:
        out = {"conv_id": self.conv, "part": part, "seq": seq, "whole": self.whole, "first_turn": self.first_turn, "last_turn": self.last_turn,
               "first_role": self.first_role, "last_role": self.last_role, **self.count}
        if self.whole:
            cost, trail = self.parses[0].best()
            edits, roles = ("".join(x) for x in zip(*trail))
            return out | {"cost": cost, "audit": edits, "repaired": apply_edits(edits, roles, self.turns)}
        exits = [(entry, all_stacks().index(stack), cost, *("".join(x) for x in zip(*Parse.written(trail))))
                 for entry, parse in enumerate(self.parses) for cost, _, stack, trail in parse.heads if trail is not None]
        if not self.turns:
            exits = [(i, i, 0, "", "") for i in range(len(all_stacks()))]
        return out | {"exits": [dict(zip(("entry", "exit", "cost", "edits", "roles"), x)) for x in exits],
                      "turns": [{"role": r, "text": t} for r, t in self.turns]}


_PIECE = ("part bigint, seq bigint, whole boolean, first_turn {turn}, last_turn {turn}, first_role string, last_role string, blank bigint, "
          "duplicate bigint, truncated bigint, illegal bigint, distinct bigint, cost bigint, audit string, repaired " + _TURNS +
          ", exits array<struct<entry:int,exit:int,cost:bigint,edits:string,roles:string>>, turns array<struct<role:string,text:string>>")


def _batches(rows, schema, limit=1):
    """Arrow batches of up to ``limit`` conversations with few turns, or of one row."""
    held, turns = [], 0
    for row in rows:
        held.append(row)
        turns += len(row.get("audit") or "")
        if len(held) >= limit or turns > 1000 or not row.get("whole"):
            yield pa.RecordBatch.from_pylist(held, schema)
            held, turns = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(rows, part):
    """Pieces of the conversations of one range.  The first may have begun
    before it and the last may go on; so may what follows a cut."""
    piece, seq = None, 0
    for conv, turn, role, text, lost, blank, cut, later in rows:
        if piece is None or conv != piece.conv:
            if piece is not None:
                yield piece.row(part, seq)
                seq += 1
            piece = _Piece(conv, whole=False) if piece is None else _Ahead(conv)
        if lost:
            continue
        full = len(piece.turns) >= SEGMENT_ROWS or piece.chars >= SEGMENT_CHARS
        if full and piece.before != (turn, role, text):
            yield piece.cut(part, seq) if isinstance(piece, _Ahead) else piece.row(part, seq)
            seq += 1
            piece = _Piece(conv, whole=False)
        piece.add(turn, role, text, blank, cut, later)
    if piece is not None:
        yield piece.cut(part, seq) if isinstance(piece, _Ahead) else piece.row(part, seq)


class _Ahead(_Piece):
    """A conversation that begins in this range.  Should it be cut or be the
    last of the range, its piece is parsed again from every stack."""

    def __init__(self, conv):
        super().__init__(conv, whole=True)
        self.log = []

    def add(self, *turn):
        super().add(*turn)
        self.log.append(turn)

    def cut(self, part, seq):
        piece = _Piece(self.conv, whole=False)
        for turn in self.log:
            piece.add(*turn)
        return piece.row(part, seq)


def _arrow_schema(spark, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _totals(first, last, count) -> dict:
    gaps = last - first + 1 - count["distinct"] if first is not None else 0
    return {"gaps": gaps, **{k: count[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _compose(rows):
    """Puts the pieces of each conversation together: one row per piece with its
    edits; the last one also has the totals and the audit."""
    from itertools import groupby
    for conv, pieces in groupby(rows, key=lambda r: r[0]):
        parse, places = Parse(), []
        count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        first = last = last_role = None
        for _, part, seq, first_turn, last_turn, first_role, end_role, *counts, exits in pieces:
            for name, n in zip(("blank", "duplicate", "truncated", "illegal", "distinct"), counts):
                count[name] += n
            if first_role is not None:
                if last_role is not None and last_role + first_role not in ("su", "ua", "au"):
                    count["illegal"] += 1
                last_role = end_role
            if first_turn is not None:
                if first is None:
                    first = first_turn
                elif first_turn == last:
                    count["distinct"] -= 1
                last = last_turn
            by_entry: dict[int, list] = {}
            for x in exits:
                by_entry.setdefault(x["entry"], []).append((x["exit"], x["cost"], x["edits"], x["roles"]))
            parse.piece(by_entry)
            places.append((part, seq))
        cost, trail = parse.best()
        trail[-2:] = [tuple(a + b for a, b in zip(*trail[-2:]))]  # closing inserts go with the last piece
        for (part, seq), (edits, roles) in zip(places, trail):
            row = {"conv_id": conv, "part": part, "seq": seq, "edits": edits, "roles": roles}
            if (part, seq) == places[-1]:
                row |= _totals(first, last, count) | {"cost": cost, "audit": "".join(e for e, _ in trail)}
            yield row


class Repair:
    """Repaired conversations: ``report`` has one row per conversation (faults,
    cost, audit), ``segments`` its repaired turns, in the order of ``part, seq``
    (one segment for nearly all)."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
        schema = f"conv_id {kind}, " + _PIECE.format(turn=turn)
        arrow = _arrow_schema(spark, schema)

        def parse(batches):
            yield from _batches(_pieces(rows_of(batches), part_id()), arrow, 500)

        found = staged(in_ranges(mark_faults(rows), ranges_for(rows), "lost", "blank", "cut", "later").mapInArrow(parse, schema), "repair-pieces")
        planned = f"conv_id {kind}, part bigint, seq bigint, edits string, roles string, {_COUNTS}"
        plan_arrow = _arrow_schema(spark, planned)

        def compose(batches):
            yield from _batches(_compose(rows_of(batches, 20)), plan_arrow)

        torn = found.where("not whole")
        plan = staged(by_conversation(torn.select("conv_id", "part", "seq", "first_turn", "last_turn", "first_role", "last_role", "blank",
                                                  "duplicate", "truncated", "illegal", "distinct", "exits"))
                      .mapInArrow(compose, planned), "repair-plan")
        fixed = f"conv_id {kind}, part bigint, seq bigint, repaired {_TURNS}"
        fixed_arrow = _arrow_schema(spark, fixed)

        def edit(batches):
            rows = ({"conv_id": c, "part": p, "seq": s, "repaired": apply_edits(e, r, ((t["role"], t["text"]) for t in turns))}
                    for c, p, s, e, r, turns in rows_of(batches, 4))
            yield from _batches(rows, fixed_arrow)

        self.torn = (torn.select("part", "seq", "turns").join(plan.select("conv_id", "part", "seq", "edits", "roles"), ["part", "seq"])
                     .select("conv_id", "part", "seq", "edits", "roles", "turns").mapInArrow(edit, fixed))
        self.kept = found.where("whole").select("conv_id", "part", "seq", "repaired")
        gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"))
        columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        self.report = (found.where("whole").withColumn("gaps", gaps.cast("bigint")).select(columns)
                       .unionByName(plan.where("audit is not null").select(columns)))

    @property
    def segments(self) -> DataFrame:
        return self.kept.unionByName(self.torn)

    def digests(self) -> DataFrame:
        """``conv_id, repaired_sha256``: SHA-256 of the repaired turns as
        ``role:text`` lines.  A digest of a conversation in pieces reads them in
        order, one after the other, as a digest must."""
        line = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        whole = self.kept.select("conv_id", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
        kind = self.kept.schema["conv_id"].dataType.simpleString()

        def hashed(batches):
            from itertools import groupby
            for conv, pieces in groupby(rows_of(batches, 4), key=lambda r: r[0]):
                total, begun = hashlib.sha256(), False
                for _, turns in pieces:
                    for t in turns:
                        total.update(("\n" * begun + t["role"] + ":" + t["text"]).encode())
                        begun = True
                yield pa.RecordBatch.from_arrays([pa.array([conv], arrow.field(0).type), pa.array([total.hexdigest()])], ["conv_id", "repaired_sha256"])

        arrow = _arrow_schema(self.kept.sparkSession, f"conv_id {kind}")
        ordered = by_conversation(self.torn).select("conv_id", "repaired")
        return whole.unionByName(ordered.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string"))


def clean_rows(rows: DataFrame) -> DataFrame:
    """The four columns that are read, null roles and texts as one blank."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("lost"))


def repair(rows: DataFrame) -> Repair:
    return Repair(clean_rows(rows))


def damaged(rows: DataFrame) -> DataFrame:
    """The planted damage of the query, by crc32 of ``conv_id:turn`` modulo 20:
    0 loses the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the
    row, 4 makes it a user turn.  Lost rows stay as a mark of their id."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = clean_rows(rows).withColumn("d", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """The report of the repaired damaged table, with the digest of the turns."""
    done = Repair(damaged(rows))
    digests = done.digests().withColumnRenamed("conv_id", "c")
    return (done.report.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
