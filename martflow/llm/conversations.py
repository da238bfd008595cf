"""Conversations repaired at least cost, so that roles read ``(s?(ua)+)?``.

An edit of a row keeps it (letter K, cost 0), gives it the role user or assistant (R, 2) or
deletes it (D, 3; blank and repeated rows must go); an empty row can be put in anywhere (I,
2); a truncated row that stays costs 1 more.  The cheapest edits win, and of those the ones
whose letters come first in ASCII.  One integer carries both: its high digits are the cost,
each lower digit one letter, first letter first, zeros at the end.  So the smallest integer
over the paths of a graph of rows and role states is the answer, and nothing else decides.

A conversation's rows pass a task as a sorted stream.  Once the paths to all states have
their first edits in common, those edits are settled and put out, so a conversation of any
length needs memory for the part still open, beside its letters.  (The hash of a repaired
text is sequential, so the rows of one conversation cannot be hashed by several tasks.)
What other rows decide is found before, with counts combined map-side: repeated rows, and
equal rows of one turn, which travel as one row with a count and, if they must go, without
their text.

Cases: a null role or text is one space, a null turn comes before all others and counts in
no gap; a null ``conv_id`` is a conversation of its own; equal turns are taken by role, then
by the SHA-256 of the text; an empty role has no initial and cannot be kept; a conversation
without rows has zeros, no letters and the hash of nothing; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import copies
from martflow.llm.vectors import LOWEST

BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "sound"

# Digits of the letters, in ASCII order; zero ends a shorter row of letters.
_BITS = 3
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
# States: nothing yet, system, user, assistant; what each initial leads to, and the role that
# an edit gives a row.  The pattern leaves no choice of that role, so letters tell all edits.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
_ENDS = (0, 3)
_LEGAL = frozenset(("su", "ua", "au"))
# What it costs at most to go on from one state as another one would: to delete the system
# row that only a beginning can keep, or to put rows in.  A path that is dearer by more than
# that can be given up.
_MIMIC = {(0, 1): 0, (0, 2): 2, (0, 3): 0, (1, 0): 7, (1, 2): 2, (1, 3): 4, (2, 0): 5, (2, 1): 2, (2, 3): 2, (3, 0): 3, (3, 1): 0, (3, 2): 2}
_OPEN = 48  # rows before paths are compared

_SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_ROWS = "conv_id long, position long, edit string, role string, text string"


def damage(rows: DataFrame) -> DataFrame:
    """The columns ``conv_id, turn, role, text`` of rows, damaged by a checksum of their
    place, and ``times``: how often each row stands there (0: dropped)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _judged(rows: DataFrame, times: str | None) -> DataFrame:
    """One row for equal rows of a turn: ``conv_id, _turn, _role, _text, _n, _fault`` and what
    they are ordered by.  The text of rows that must go is left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    bare = F.rtrim(F.regexp_replace(F.col("_text"), r"[\x09-\x0D]", " "))
    base = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("_role"),
        text.alias("_text"),
        F.sha2(text, 256).alias("_digest"),
        (F.col(times).cast("long") if times else F.lit(1).cast("long")).alias("_n"),
    ).select(
        "*",
        F.coalesce("_turn", F.lit(LOWEST)).alias("_order"),
        F.when(F.length(bare) == 0, BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("_fault"),
    )
    # Equal rows of a conversation; a row of several counts among them only if it meets others.
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), "_digest", "_role"), 256)
    base = base.withColumn("_hash", F.when((F.col("_n") > 0) & (F.col("_fault") != BLANK), key))
    again = copies(base, F.col("_hash"), "_order", label="equal-turns").select("_key", "_first")
    met = base.join(again, F.col("_hash") == F.col("_key"), "left")
    columns = ["conv_id", "_turn", "_order", "_role", "_digest", "_fault", "_text", "_n"]
    alone = met.where("_first is null").withColumn("_text", F.when(F.col("_fault") != BLANK, F.col("_text")))
    later = F.col("_order") > F.col("_first")
    several = (
        met.where("_first is not null")
        .withColumn("_fault", F.when(later, DUPLICATE).otherwise(F.col("_fault")))
        .withColumn("_text", F.when(~later, F.col("_text")))
        .groupBy(*columns[:-1])
        .agg(F.sum("_n").alias("_n"))
    )
    return alone.select(*columns).union(several.select(*columns))


def _ones(n: int) -> int:
    """The digit one, ``n`` times."""
    return ((1 << (_BITS * n)) - 1) // ((1 << _BITS) - 1)


class Conversation:
    """One conversation while its rows stream by.  ``put(letter, role, text)`` gets every
    settled edit that is not the deletion of a row, in order."""

    def __init__(self, put):
        self.put = put
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal = self.cost = 0
        self.audit = bytearray()
        self.low = self.high = self.at = None
        self.turns = 0
        self.initial = None
        self.width, self.limit = 4 * _OPEN, _OPEN
        # For each state: the weight, the number of letters in it, and the edits, newest first.
        self.nodes: list[tuple | None] = [(0, 0, None), None, None, None]
        self.open = 0

    def row(self, turn: int | None, role: str, text: str | None, n: int, fault: str) -> None:
        """``n`` equal rows; all but the first of them repeat it."""
        rest = BLANK if fault == BLANK else DUPLICATE
        if fault != SOUND:
            self.counts[fault] += 1
        self.counts[rest] += n - 1
        if turn is not None:
            if turn != self.at:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.at = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.initial = initial
        if fault in (BLANK, DUPLICATE):
            self._delete(n)
        else:
            self._edit(role, text, initial, fault == TRUNCATED)
            if n > 1:
                self._delete(n - 1)
        self.open += 1
        if self.open >= self.limit:
            self._settle()

    def _room(self, letters: int) -> None:
        """Make the weights wide enough for more letters: zeros at the end."""
        longest = max(node[1] for node in self.nodes if node) + letters
        if longest > self.width:
            more = longest + 4 * _OPEN - self.width
            self.width += more
            self.nodes = [node and (node[0] << (_BITS * more), node[1], node[2]) for node in self.nodes]

    def _weight(self, cost: int, letter: str, length: int) -> int:
        """What an edit adds: its cost above all letters, its letter at its own place."""
        return (cost << (_BITS * self.width)) + (_DIGIT[letter] << (_BITS * (self.width - 1 - length)))

    def _delete(self, n: int) -> None:
        self._room(n)
        for state, node in enumerate(self.nodes):
            if node:
                weight, length, path = node
                weight += (3 * n << (_BITS * self.width)) + (_DIGIT["D"] * _ones(n) << (_BITS * (self.width - length - n)))
                self.nodes[state] = (weight, length + n, [path, "D", n, 3 * n, None])

    def _inserted(self) -> list[tuple | None]:
        """The nodes after up to two rows put in; more would lead back to a state."""
        nodes, last = list(self.nodes), self.nodes
        for _ in range(2):
            new: list[tuple | None] = [None] * 4
            for state, node in enumerate(last):
                if node:
                    to, role = _NEXT[state]
                    weight, length, path = node
                    weight += self._weight(2, "I", length)
                    if new[to] is None or weight < new[to][0]:
                        new[to] = (weight, length + 1, [path, "I", role, 2, ""])
            nodes = [min((x for x in pair if x), key=lambda x: x[0], default=None) for pair in zip(nodes, new, strict=True)]
            last = new
        return nodes

    def _edit(self, role: str, text: str, initial: str, truncated: bool) -> None:
        self._room(3)
        new: list[tuple | None] = [None] * 4
        for state, node in enumerate(self._inserted()):
            if not node:
                continue
            weight, length, path = node
            kept, (given, other) = _AFTER[state].get(initial), _NEXT[state]
            for to, letter, cost, edit in (
                (state, "D", 3, 1),
                (kept, "K", truncated, role),
                (given, "R", 2 + truncated, other),
            ):
                if to is not None:
                    value = weight + self._weight(cost, letter, length)
                    if new[to] is None or value < new[to][0]:
                        new[to] = (value, length + 1, [path, letter, edit, cost, text])
        self.nodes = new

    def _settle(self, final: tuple | None = None) -> None:
        """Put out the edits that all paths have in common, or all of ``final``."""
        costs = [node and node[0] >> (_BITS * self.width) for node in self.nodes]
        for (one, other), more in _MIMIC.items():
            if costs[one] is not None and costs[other] is not None and costs[other] > costs[one] + more:
                self.nodes[other] = None
        paths = []
        for node in [final] if final else self.nodes:
            if node:
                steps, path = [], node[2]
                while path is not None:
                    steps.append(path)
                    path = path[0]
                paths.append(steps[::-1])
        shared = min(map(len, paths))
        for k in range(shared):
            if any(p[k] is not paths[0][k] for p in paths):
                shared = k
                break
        for _, letter, edit, cost, text in paths[0][:shared]:
            self.cost += cost
            self.audit += letter.encode() * (edit if letter == "D" else 1)
            if letter != "D":
                self.put(letter, edit, text)
        if final:
            return
        for path in paths:  # cut off what is settled
            if len(path) > shared:
                path[shared][0] = None
        self.open = max(map(len, paths)) - shared
        self.limit = 2 * self.open + _OPEN
        letters = [sum(step[2] if step[1] == "D" else 1 for step in path[shared:]) for path in paths]
        self.width = max(letters) + 4 * _OPEN
        left = iter(paths)
        self.nodes = [node and self._weighed(next(left)[shared:]) for node in self.nodes]

    def _weighed(self, steps: list[list]) -> tuple:
        """A node for the edits still open."""
        weight = length = 0
        for _, letter, edit, cost, _ in steps:
            n = edit if letter == "D" else 1
            weight += (cost << (_BITS * self.width)) + (_DIGIT[letter] * _ones(n) << (_BITS * (self.width - length - n)))
            length += n
        return weight, length, steps[-1] if steps else None

    def finish(self) -> dict:
        self._room(2)
        ends = [node for state, node in enumerate(self._inserted()) if node and state in _ENDS]
        self._settle(min(ends, key=lambda node: node[0]))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost, "audit": self.audit.decode()}


def _conversations(batches: Iterator[pa.RecordBatch], put, each: bool = False):
    """Each conversation of a sorted stream once all its rows are in; ``put(conv_id)`` makes
    what takes its edits.  ``each``: finish it, and stop after every row as well, so that
    edits can be taken on."""
    conv, now = None, None
    for batch in batches:
        names = ("conv_id", "_turn", "_role", "_text", "_n", "_fault")
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or conv_id != conv:
                if now is not None:
                    if each:
                        now.finish()
                    yield conv, now
                conv, now = conv_id, Conversation(put(conv_id))
            if row[3]:
                now.row(*row)
                if each:
                    yield conv, now
    if now is not None:
        if each:
            now.finish()
        yield conv, now


def _streamed(rows: DataFrame, times: str | None) -> DataFrame:
    """Rows by conversation, in order.  Nothing is collected: Spark sorts with spilling."""
    judged = _judged(rows, times)
    return judged.repartition("conv_id").sortWithinPartitions("conv_id", "_order", "_role", "_digest")


def _batches(rows: Iterator[tuple], names: list[str], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of about ``size`` characters; the last column but one or
    two may be long."""
    kinds = [pa.string() if n in ("audit", "repaired_sha256", "edit", "role", "text") else pa.int64() for n in names]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 50 + len(row[-1]) + len(row[-2])
        if total >= size:
            yield batch(held)
            held, total = [], 0
    if held:
        yield batch(held)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def summarise(rows: DataFrame, times: str | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``conv_id, turn, role, text``: what was wrong, the cost
    and letters of the cheapest edits and the hash of the repaired text, its rows
    ``role:text`` joined by line feeds.  ``times`` names a column of how often a row stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = {}

        def put(_):
            hashed["sum"], hashed["lead"] = hashlib.sha256(), ""

            def edit(letter: str, role: str, text: str) -> None:
                hashed["sum"].update(f"{hashed['lead']}{role}:{text}".encode())
                hashed["lead"] = "\n"

            return edit

        found = ((conv, *now.finish().values(), hashed["sum"].hexdigest()) for conv, now in _conversations(batches, put))
        yield from _batches(found, _names(_SUMMARY))

    return _streamed(rows, times).mapInArrow(run, _SUMMARY)


def repair(rows: DataFrame, times: str | None = None) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id``, ``position`` from 0, the letter of
    the ``edit``, ``role`` and ``text``.  A conversation of which nothing is left has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []

        def put(conv):
            place = iter(range(1 << 62))
            return lambda letter, role, text: ready.append((conv, next(place), letter, role, text))

        def rows_of_all() -> Iterator[tuple]:
            for _ in _conversations(batches, put, each=True):
                yield from ready
                ready.clear()

        yield from _batches(rows_of_all(), _names(_ROWS))

    return _streamed(rows, times).mapInArrow(run, _ROWS)
