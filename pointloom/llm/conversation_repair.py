"""Repair of conversation structure by error-correcting Earley parsing.

A weighted grammar says which roles may follow each other; productions for deleting a row, changing its role
and inserting one make every conversation parsable, and the cheapest derivation is the repair. The grammar is
left-linear, so every chart item starts at the first column, and a column is what has been completed at it:
for each nonterminal the least (cost, audit), the audit being the initials of the edits. Within a column
items are completed best first, insertions lead on in it, scanning a row leads to the next.

Audits are never compared letter by letter over a conversation: all in a column have consumed the same rows
and end each with a letter that consumes one, so none is a prefix of another and their order is that of the
column before, then of the letters since. Costs from the least and that order are all that a column's
successors depend on, so they are worked out once for each (column, kind of row) and looked up from then on.

Scale: rows are damaged, compared and sorted by Spark in one shuffle by conversation and stream through the
chart in Arrow batches. A conversation keeps four bytes a row, for the way back, whatever its texts are: each
item has the running hash of what it has repaired. A hash of a whole text is serial, so the rows of one
conversation pass through one task in their order; they are spilled by Spark's sort, not held.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Roles that rows may be changed to and that may be inserted, by their initial.
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset({"su", "ua", "au"})
DROP = "drop"
#: What each nonterminal is made of: another one, then a role or a deleted row. NONE has nothing said yet.
GRAMMAR = {
    "NONE": [("NONE", DROP)],
    "HEAD": [("NONE", "s"), ("HEAD", DROP)],
    "OPEN": [("NONE", "u"), ("HEAD", "u"), ("PAIRS", "u"), ("OPEN", DROP)],
    "PAIRS": [("OPEN", "a"), ("PAIRS", DROP)],
}
FIRST, ACCEPTED = "NONE", ("NONE", "PAIRS")
#: More than any state is worth over the cheapest of its column: two insertions lead from each to PAIRS, which
#: can go on as any other does but for one system row, which it deletes. Dearer ones can't be part of a repair.
SLACK = 2 * INSERT + DELETE


@dataclass(frozen=True)
class Token:
    """A row as the grammar sees it."""

    initial: str
    truncated: bool = False
    must_go: bool = False


#: A completed nonterminal of a column: its name, cost beyond the column's least, order of its audit.
Entry = tuple[str, int, int]
#: How an entry came about: the entry before, roles inserted since, the row's letter, its role if it stays.
Back = tuple[int, str, str, str | None]


class Chart:
    """Columns met so far and the steps between them."""

    def __init__(self, grammar: dict[str, list[tuple[str, str]]] = GRAMMAR, first: str = FIRST, accepted: tuple[str, ...] = ACCEPTED):
        self.rules = [(made, of, symbol) for made, rules in grammar.items() for of, symbol in rules]
        self.accepted, self.start = accepted, ((first, 0, 0),)
        self.known: dict[tuple[tuple[Entry, ...], Token], int] = {}
        self.steps: list[tuple[tuple[Entry, ...], int, tuple[Back, ...]]] = []

    def closed(self, column: tuple[Entry, ...]) -> dict[str, tuple[int, int, str, int]]:
        """Each nonterminal's least (cost, order of audit, roles inserted since, entry it comes from)."""
        heap = [((cost, order, ""), name, "", i) for i, (name, cost, order) in enumerate(column)]
        heapq.heapify(heap)
        out: dict[str, tuple[int, int, str, int]] = {}
        while heap:
            (cost, order, letters), name, roles, i = heapq.heappop(heap)
            if name in out:
                continue
            out[name] = (cost, order, roles, i)
            for made, of, symbol in self.rules:
                if of == name and symbol in ROLES and made not in out:
                    heapq.heappush(heap, ((cost + INSERT, order, letters + "I"), made, roles + symbol, i))
        return out

    def step(self, column: tuple[Entry, ...], token: Token) -> int:
        """Number of the step from ``column`` over a row; ``steps`` has the next column, its cost and the way back."""
        if (column, token) in self.known:
            return self.known[column, token]
        done, best = self.closed(column), {}
        for made, of, symbol in self.rules:
            if of not in done:
                continue
            cost, order, roles, i = done[of]
            ways = []
            if symbol == DROP:
                ways.append((DELETE, "D", None))
            elif not token.must_go:
                ways += [(0, "K", symbol)] * (symbol == token.initial) + [(REROLE, "R", symbol)] * (symbol in ROLES)
            for extra, letter, role in ways:
                extra += TRUNCATED * (token.truncated and letter != "D")
                key = (cost + extra, order, "I" * len(roles) + letter)
                if made not in best or key < best[made][0]:
                    best[made] = (key, (i, roles, letter, role))
        least = min(key[0] for key, _ in best.values())
        best = {made: way for made, way in best.items() if way[0][0] - least <= SLACK}
        audits = sorted({key[1:] for key, _ in best.values()})
        made = sorted(best)
        after = tuple((name, best[name][0][0] - least, audits.index(best[name][0][1:])) for name in made)
        self.known[column, token] = len(self.steps)
        self.steps.append((after, least, tuple(best[name][1] for name in made)))
        return len(self.steps) - 1

    def finish(self, column: tuple[Entry, ...]) -> tuple[int, str, int]:
        """Cost beyond the column's, roles inserted at the end and the entry they follow."""
        done = self.closed(column)
        cost, order, roles, i = min((done[name][0], done[name][1], done[name][2], done[name][3]) for name in self.accepted if name in done)
        return cost, roles, i


class Conversation:
    """One conversation's rows in turn; constant memory but for four bytes a row."""

    def __init__(self, chart: Chart):
        self.chart, self.column, self.path, self.cost = chart, chart.start, array("I"), 0
        self.hashes, self.lines = [hashlib.sha256()], [False]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = self.before = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.low = turn if self.turns == 0 else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if again else "truncated" if said[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        token = Token(initial if initial in ("s", "u", "a") else "", fault == "truncated", fault in ("blank", "duplicate"))
        number = self.chart.step(self.column, token)
        self.column, least, backs = self.chart.steps[number]
        self.path.append(number)
        self.cost += least
        hashes, lines = [], []
        for i, roles, letter, own in backs:
            h, some = self.hashes[i].copy(), self.lines[i]
            new = [f"{ROLES[r]}:" for r in roles]
            if letter != "D":
                new.append(f"{role if letter == 'K' else ROLES[own]}:{text}")
            self._feed(h, new, some)
            hashes.append(h)
            lines.append(some or bool(new))
        self.hashes, self.lines = hashes, lines

    @staticmethod
    def _feed(h, new: list[str], some: bool) -> None:
        if new:
            h.update((("\n" if some else "") + "\n".join(new)).encode("utf-8", "surrogatepass"))

    def result(self) -> dict:
        cost, roles, i = self.chart.finish(self.column)
        h = self.hashes[i].copy()
        self._feed(h, [f"{ROLES[r]}:" for r in roles], self.lines[i])
        letters = ["I" * len(roles)]
        for number in reversed(self.path):
            i, inserted, letter, _ = self.chart.steps[number][2][i]
            letters.append("I" * len(inserted) + letter)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"gaps": gaps} | self.counts | {"cost": self.cost + cost, "audit": "".join(reversed(letters)), "repaired_sha256": h.hexdigest()}


_OUT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_OUT_DDL = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULTS = 1024


def damaged(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, turn, role, text`` of ``turns`` with the stated damage, and ``lost`` for rows that it drops.

    By the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays here, marked), 1 empties its text, 2
    removes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls, of the id
    and number in that key too, count as one space there; ``conv_id`` and ``turn`` themselves stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(said(id_col), F.lit(":"), said("turn")).cast("binary")) % 20).cast("int").alias("_code")
    t = turns.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), code)
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_code") == 0).alias("lost"), copies.alias("_copy")).drop("_copy")


def _in_order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id, turn, role, text, lost`` as ``damaged`` gives them).

    Rows go by turn, nulls first, those of one turn by role and text; lost ones only make sure that their
    conversation has a row. Columns: ``conv_id``; ``gaps``, turns missing between the least and the greatest;
    ``blank``, ``duplicate``, ``truncated``, rows by their first fault; ``illegal``, adjacent roles that may not
    follow each other; ``cost`` and ``audit`` of the cheapest repair, of equal ones the one whose audit sorts
    first; ``repaired_sha256`` of its lines ``role:text``. Null roles and texts count as a space. A null id is one
    conversation. Conversations without rows have zeros, an empty audit and the hash of nothing; empty input
    gives no rows. Other columns are not looked at.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text"), F.coalesce("lost", F.lit(False)).alias("lost"))
    seen = Window.partitionBy("conv_id", "role", "text", "lost").orderBy(F.asc_nulls_first("turn"))
    rows = rows.repartition("conv_id").withColumn("_again", F.row_number().over(seen) > 1).sortWithinPartitions(*_in_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, key, current, ids, found = Chart(), None, None, [], []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[n] for r in found], t) for n, t in _OUT]
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_type), *cols], ["conv_id", *(n for n, _ in _OUT)])
            ids.clear()
            found.clear()
            return out

        for part in batches:
            id_type = part.schema.field("conv_id").type
            for conv, turn, role, text, lost, again in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "lost", "_again")), strict=True):
                if current is None or conv != key:
                    if current is not None:
                        ids.append(key)
                        found.append(current.result())
                        if len(ids) >= _RESULTS:
                            yield batch()
                    key, current = conv, Conversation(chart)
                if not lost:
                    current.add(turn, role, text, again)
        if current is not None:
            ids.append(key)
            found.append(current.result())
            yield batch()

    return rows.mapInArrow(run, f"conv_id {kind}, {_OUT_DDL}")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit``, one row per row that stays or is inserted.

    ``turns`` and ``found`` are what ``repair`` took and gave. Letters of an audit that consume a row meet it by
    its number; roles of changed and inserted rows follow from their place.
    """
    by = Window.partitionBy("conv_id").orderBy(*_in_order()[1:])  # spilled by Spark, not held
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.where("NOT coalesce(lost, false)").select("conv_id", "turn", space("role"), space("text")).withColumn("_number", F.row_number().over(by)).drop("turn")
    edits = found.select("conv_id", F.posexplode(F.split("audit", "")).alias("_at", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumn("_number", F.sum((F.col("edit") != "I").cast("int")).over(upto)).withColumn("place", F.sum((F.col("edit") != "D").cast("int")).over(upto) - 1).where("edit <> 'D'")
    own = F.when(F.col("edit") != "I", F.col("_number")).alias("_number")
    edits = edits.select("conv_id", "place", "edit", own).alias("e")
    out = edits.join(rows.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("e._number") == F.col("r._number")), "left").select("e.conv_id", "place", "edit", "role", "text")
    # A system row can only come first; after it users and assistants take turns.
    head = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K"), F.col("role").startswith("s"))).over(Window.partitionBy("conv_id"))
    turn = F.pmod(F.col("place") - F.coalesce(head, F.lit(False)).cast("int"), F.lit(2))
    role = F.when(F.col("edit") == "K", F.col("role")).when(turn == 0, ROLES["u"]).otherwise(ROLES["a"])
    return out.select("conv_id", "place", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
