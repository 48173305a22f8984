"""Repair of conversations at least cost, by a weighted automaton that is made deterministic as it is needed.

A conversation is to read ``(s?(ua)+)?`` by the initials of its roles. A row may
be kept (cost 0), get the role user or assistant (``REROLE``) or be deleted
(``DELETE``); empty turns of user or assistant may be put in anywhere
(``INSERT``). A truncated row that is not deleted costs ``TRUNCATED`` more; blank
and duplicate rows must be deleted. What was read so far is one of four states:
nothing, a system turn, up to a user, up to an assistant.

For all states together, the costs of what is still to come are a vector. Less
its least number it takes few values, which are the states of the deterministic
automaton; (vector, kind of row) to (vector before the row, cost to add) is
computed when it is first met and then read from a table. A scan of the rows from
last to first through that table gives the cost; the trace goes back over the
scan, so from first to last, along arcs whose cost makes up the difference
exactly, taking of each place the edit with the least initial. As a state and an
initial leave one next state, that gives the ASCII-least of the cheapest audits.

Scale: rows are range-sorted by conversation, turn, role and digest of the text
into slices, equal rows too, so neither a conversation nor a turn nor copies with
a third of all rows are one task's. The scan of a slice needs the vector behind its
last row: for a conversation over several slices each gives the costs from every
state to every state (the scan from four unit vectors), which are chained over the
slices, at most two conversations a slice. A kind takes a byte, a vector four.
Only the digest of a repaired conversation and its audit have to be written in one
place; rows stream there in order, and what is held is the audit and a slice's
vectors. Which row of equal ones is first is decided by the least place.

Null roles and texts are one space; null turns come first; turns with equal
numbers are ordered by role and the SHA-256 of the text; repeated rows are
separate rows, of which the first is no duplicate. A role without a letter has no
initial that may stay. A null conv_id is a conversation of its own. Conversations
without rows give zeros, an empty audit and the digest of nothing. Empty tables
give no rows. Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.base import WHITE, written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Of each state: the role that may come next by an edit, and the state after it.
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Kinds of rows: the initial, or ``TRUNC`` more if the row is truncated; then those that must go.
INITIALS, TRUNC, BLANK, DUPLICATE = "sua?", 4, 8, 9
NEVER = 255

Vector = tuple[int, int, int, int]
END: Vector = (0, 2 * INSERT, INSERT, 0)


def pack(v: Vector) -> int:
    return v[0] | v[1] << 8 | v[2] << 16 | v[3] << 24


def unpack(x: int) -> Vector:
    return x & 255, x >> 8 & 255, x >> 16 & 255, x >> 24 & 255


def arcs(kind: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that take a row of the kind."""
    yield "D", DELETE, state
    if kind < BLANK:
        more = TRUNCATED if kind >= TRUNC else 0
        kept = KEEPS.get((state, INITIALS[kind % TRUNC]))
        if kept is not None:
            yield "K", more, kept
        yield "R", REROLE + more, NEXT[state]


class Table:
    """The transitions and traces that have been met so far; both depend on their keys alone."""

    def __init__(self) -> None:
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, tuple, int]] = {}

    def costs(self, after: Vector, kind: int) -> list[int]:
        """Of each state before a row, the least cost from there on."""
        take = [min((cost + after[to] for _, cost, to in arcs(kind, q) if after[to] < NEVER), default=NEVER) for q in range(4)]
        user, assistant = min(take[USER], INSERT + take[ASSISTANT]), min(take[ASSISTANT], INSERT + take[USER])
        return [min(take[START], INSERT + user), min(take[SYSTEM], INSERT + user), user, assistant]

    def move(self, after: int, kind: int) -> tuple[int, int]:
        """The vector before a row, less its least number, and that number."""
        found = self.moves.get((after, kind))
        if found is None:
            costs = self.costs(unpack(after), kind)
            least = min(costs)
            found = self.moves[after, kind] = pack(tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in costs)), least
        return found

    def scan(self, kinds: bytes, after: int) -> tuple[list[int], int, int]:
        """Of rows from last to first: the vector behind each, that before the first, and the sum of the numbers taken off."""
        behind, total = [0] * len(kinds), 0
        for i in range(len(kinds) - 1, -1, -1):
            behind[i] = after
            after, least = self.move(after, kinds[i])
            total += least
        return behind, after, total

    def trace(self, after: int, kind: int, state: int) -> tuple[str, tuple, int]:
        """The edits up to and with that of a row, the roles of their turns (None: the row's own) and the state behind it."""
        found = self.traces.get((after, kind, state))
        if found is None:
            behind, edits, roles, q = unpack(after), "", [], state
            here = self.costs(behind, kind)
            while True:
                tight = [(e, to) for e, cost, to in arcs(kind, q) if behind[to] < NEVER and cost + behind[to] == here[q]]
                tight += [("I", NEXT[q])] if INSERT + here[NEXT[q]] == here[q] else []
                edit, to = min(tight)
                edits += edit
                if edit != "D":
                    roles.append((edit, None if edit == "K" else NEXT_ROLE[q]))
                q = to
                if edit != "I":
                    break
            found = self.traces[after, kind, state] = edits, tuple(roles), q
        return found


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage that the row's key decides: a twentieth each is dropped, emptied, robbed of its ends, repeated, given to the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    left = rows.filter(harm != 0).select("conv_id", "turn", F.when(harm == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(harm == 3, 2).otherwise(1).alias("_times"))
    return left.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("conv_id", "turn", "role", "text")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with ``at``: slice and place in it as one number, which follows conversation, turn, role and digest."""
    shown = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    # The salt only parts equal rows, which are interchangeable.
    slim = rows.select("conv_id", "turn", shown("role"), shown("text")).withColumns({"digest": F.sha2("text", 256), "_salt": F.monotonically_increasing_id()})
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "_salt"]
    bare = F.btrim("text", F.lit(WHITE))
    return slim.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv_id", "turn", "role", "text", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("at"),
    )


def _slice(at: Column) -> Column:
    return F.shiftright(at, 33)


def _segments(placed: DataFrame) -> DataFrame:
    """(conv_id, at, kinds, edge): a conversation's rows in a slice, ``at`` the first; ``edge`` if it may go on in another slice."""
    initial = F.instr(F.lit(INITIALS[:3]), F.left("role", F.lit(1))).cast("int")
    own = F.when(F.col("blank"), BLANK).otherwise(F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1) + F.when(F.col("truncated"), TRUNC).otherwise(0))
    slim = placed.select("at", "conv_id", own.cast("int").alias("kind"))
    # A row of kind -1 before a row says that no earlier one has its role and text.
    first = placed.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", "conv_id", F.lit(-1).alias("kind"))
    conv = placed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current, is_first, last_slice = [], None, False, -1
        for batch in batches:
            for at, conv_id, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind < 0:
                    is_first = True
                    continue
                number = at >> 33
                if current is None or number != last_slice or conv_id != current[0]:
                    if current:
                        current[3] |= number != last_slice
                        made.append(current)
                    current, last_slice = [conv_id, at, bytearray(), number != last_slice], number
                current[2].append(kind if is_first or kind == BLANK else DUPLICATE)
                is_first = False
            if len(made) >= 1000:
                yield _batch(made, types)
                made = []
        if current:
            current[3] = True
            made.append(current)
        yield _batch(made, types)

    types = [(placed.schema["conv_id"].dataType, "conv_id"), (pa.int64(), "at"), (pa.binary(), "kinds"), (pa.bool_(), "edge")]
    types = _arrow(types)
    dealt = slim.unionByName(first).repartition(_slice(F.col("at"))).sortWithinPartitions("at", "kind")
    return dealt.mapInArrow(run, f"conv_id {conv}, at long, kinds binary, edge boolean")


def _arrow(types: list) -> list[tuple[pa.DataType, str]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return [(to_arrow_type(t) if isinstance(t, DataType) else t, name) for t, name in types]


def _batch(rows: list, types: list[tuple[pa.DataType, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array([bytes(x) if isinstance(x, bytearray) else x for x in c], t) for c, (t, _) in zip(columns, types, strict=True)], [n for _, n in types])


def _after_edges(segments: DataFrame) -> DataFrame:
    """(at, after): the vector behind each edge segment, chained over the slices of its conversation."""
    unit = [pack(tuple(0 if q == k else NEVER for q in range(4))) for k in range(4)]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            rows = []
            for conv_id, at, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ways = []
                for k in range(4):  # from every state to state k
                    _, before, total = table.scan(kinds, unit[k])
                    ways += [c + total if c < NEVER else -1 for c in unpack(before)]
                rows.append((conv_id, at, ways))
            yield _batch(rows, types)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                after = list(END)
                for part in reversed(parts):
                    least = min(after)
                    rows.append((part["at"], pack(tuple(a - least for a in after))))
                    ways = part["ways"]
                    after = [min(ways[4 * k + q] + after[k] for k in range(4) if ways[4 * k + q] >= 0) for q in range(4)]
            yield _batch(rows, [(pa.int64(), "at"), (pa.int64(), "after")])

    types = _arrow([(segments.schema["conv_id"].dataType, "conv_id"), (pa.int64(), "at"), (pa.list_(pa.int64()), "ways")])
    conv = segments.schema["conv_id"].dataType.simpleString()
    ways = segments.filter("edge").select("conv_id", "at", "kinds").mapInArrow(crossed, f"conv_id {conv}, at long, ways array<long>")
    parts = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "ways"))).alias("parts"))
    return parts.select("parts").mapInArrow(chained, "at long, after long")


def _scanned(segments: DataFrame) -> DataFrame:
    """(conv_id, at, kinds, behind, cost): the vectors behind the rows; what the segment adds to the cost of its conversation."""
    after = written(_after_edges(segments))  # at most two rows a slice
    known = segments.join(F.broadcast(after), "at", "left").select("conv_id", "at", "kinds", F.coalesce("after", F.lit(pack(END))))
    conv = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            rows = []
            for conv_id, at, kinds, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                behind, before, total = table.scan(kinds, end)
                rows.append((conv_id, at, kinds, np.array(behind, np.uint32).tobytes(), unpack(before)[START], total))
            yield _batch(rows, types)

    types = _arrow([(segments.schema["conv_id"].dataType, "conv_id"), (pa.int64(), "at"), (pa.binary(), "kinds"), (pa.binary(), "behind"), (pa.int64(), "start"), (pa.int64(), "total")])
    return known.mapInArrow(run, f"conv_id {conv}, at long, kinds binary, behind binary, start long, total long")


class _Written:
    """A conversation as its rows come, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.audit, self.sha, self.empty = conv_id, START, [], hashlib.sha256(), True
        self.faults = [0, 0, 0]
        self.illegal = self.distinct = self.cost = 0
        self.initial = self.low = self.high = self.kinds = None

    def segment(self, kinds: bytes, behind: bytes, start: int, total: int) -> None:
        if self.kinds is None:
            self.cost = start
        self.cost += total
        self.kinds, self.behind, self.nth = kinds, np.frombuffer(behind, np.uint32), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def row(self, table: Table, turn, role: str, text: str) -> None:
        kind, after = self.kinds[self.nth], int(self.behind[self.nth])
        self.nth += 1
        if kind >= TRUNC:
            self.faults[kind - BLANK if kind >= BLANK else 2] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        edits, turns, self.state = table.trace(after, kind, self.state)
        self.audit.append(edits)
        for edit, other in turns:
            self.line(other or role, "" if edit == "I" else text)

    def result(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.audit.append("I")
            self.line(NEXT_ROLE[self.state], "")
            self.state = NEXT[self.state]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per conv_id of ``rows`` and ``conversations``: faults, least cost, audit and the digest of what the repair leaves."""
    placed = written(_placed(rows))
    scanned = _scanned(written(_segments(placed)))
    conv = placed.schema["conv_id"].dataType.simpleString()
    shape = {"kind": "int", "at": "long", "turn": "long", "role": "string", "text": "string", "kinds": "binary", "behind": "binary", "start": "long", "total": "long"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).select("conv_id", *((F.col(c) if c in df.columns or c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in shape.items()))

    named = conversations.select("conv_id").distinct().withColumn("at", F.lit(-1))
    every = shaped(named, 0).unionByName(shaped(scanned, 1)).unionByName(shaped(placed.select("conv_id", "at", "turn", "role", "text"), 2))
    dealt = every.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = Table(), None
        for batch in batches:
            done = []
            for conv_id, part in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
                if own is None or own.conv_id != conv_id:
                    done += [own.result()] if own else []
                    own = _Written(conv_id)
                for _, kind, _, turn, role, text, *scan in part:
                    if kind == 1:
                        own.segment(*scan)
                    elif kind == 2:
                        own.row(table, turn, role, text)
            yield _batch(done, types)
        if own:
            yield _batch([own.result()], types)

    counts = "gaps blank duplicate truncated illegal cost".split()
    types = _arrow([(placed.schema["conv_id"].dataType, "conv_id"), *((pa.int64(), c) for c in counts), (pa.string(), "audit"), (pa.string(), "repaired_sha256")])
    return dealt.mapInArrow(run, f"conv_id {conv}, " + "".join(f"{c} long, " for c in counts) + "audit string, repaired_sha256 string")
