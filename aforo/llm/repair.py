"""Repair of conversation structure: the cheapest audit of edits, found by a persistent dynamic program.

A sound conversation is empty, or an optional system turn and then pairs of user
and assistant; a role counts by its first letter. Edits are Keep (0), Rerole to
user or assistant (3), Delete (4, the only edit of a blank or repeated turn) and
Insert of an empty turn (3); a truncated turn that stays costs 3 more. Of the
cheapest audits, the one whose initials are least in ASCII order is taken.

Turns are read in order with the best audit that leads to each of four states
(nothing yet, after system, after user, after assistant). An audit is a node
linked to the audit it extends, so all share their prefixes. A node carries
binary-lifting ancestors and a rolling hash of its initials. Of two audits of
equal cost the longest common prefix is searched by lifting both to ancestors
whose hashes differ, and the next initials decide. Equal hashes of different
nodes are verified letter by letter. Two audits that lead to one state at equal
cost are never prefixes of each other (the longer one only inserts more), so the
least one stays least whatever follows.

An audit that can no longer win is dropped: one after system that costs more than
that after assistant, and one with nothing yet that costs more than that and a
Delete. Every ``SETTLE`` turns, what all living audits share is final: its edits
are given out and forgotten. Memory is then what the states still disagree about,
however long the conversation is. Spark deals conversations to tasks, sorted by
turn, and streams them through in Arrow batches. Whether a turn was said before is
found by partial minima over (conversation, turn's digest), not by a set held in a task.
The report of a conversation is a digest over all its turns, so a conversation
with a third of all rows passes through one task, as a stream.

Null role or text: one space. Turns go by number, null first, then role and text
(bytewise). Repeated rows are duplicates. A null id is a conversation of its own.
An empty table gives no rows. Columns are picked by name, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from aforo.llm.common import pick

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. What each may be followed by.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The turn that may be made up in each state.
MADE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
SETTLE = 512
MODULUS, BASE = (1 << 61) - 1, 1_000_003
WHITE = " \t\n\x0b\f\r"


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    blank: bool
    repeated: bool
    cut: bool


class Edit(NamedTuple):
    """An edit's initial, the number of the turn it was done to, and the turn that stays (no role: none)."""

    initial: str
    turn: int | None
    role: str | None
    text: str | None


class Audits:
    """Strings of edits as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.clear()

    def clear(self) -> None:
        self.edit: list[Edit | None] = [None]
        self.depth, self.hash = [0], [0]
        #: ancestors at distances 1, 2, 4, …
        self.up: list[tuple[int, ...]] = [()]

    def extend(self, node: int, edit: Edit) -> int:
        above, k = [node], 0
        while k < len(self.up[above[k]]):
            above.append(self.up[above[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit.initial)) % self.modulus)
        self.up.append(tuple(above))
        return len(self.up) - 1

    def lift(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same; equal hashes are verified."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a].initial != self.edit[b].initial:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        short = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, self.depth[a] - short), self.lift(b, self.depth[b] - short)
        if self.equal(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.up[x]))):
            # shallower nodes have fewer ancestors
            if k < len(self.up[x]) and not self.equal(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.edit[x].initial < self.edit[y].initial

    def trail(self, node: int, stop: int = 0) -> list[Edit]:
        """The edits after ``stop`` up to the node, in order."""
        out = []
        while node != stop:
            out.append(self.edit[node])
            node = self.up[node][0]
        return out[::-1]

    def shared(self, a: int, b: int) -> int:
        """The last node that both trails pass."""
        short = min(self.depth[a], self.depth[b])
        a, b = self.lift(a, self.depth[a] - short), self.lift(b, self.depth[b] - short)
        while a != b:
            a, b = self.up[a][0], self.up[b][0]
        return a


class Repair:
    """The dynamic program of one conversation; yields its edits as they become final."""

    def __init__(self, modulus: int = MODULUS, settle: int = SETTLE) -> None:
        self.audits, self.settle, self.seen = Audits(modulus), settle, 0
        self.cells: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def _offer(self, state: int, cost: int, node: int, edit: Edit) -> None:
        """The state's audit becomes the one that extends ``node``, if that is cheaper, or as cheap and less."""
        old = self.cells[state]
        if old is not None and old[0] < cost:
            return
        new = self.audits.extend(node, edit)
        if old is None or cost < old[0] or self.audits.less(new, old[1]):
            self.cells[state] = (cost, new)

    def _insert(self) -> None:
        # into USER first: no cheapest audit inserts more than a user and then an assistant
        for state in (START, SYSTEM, ASSISTANT, USER):
            if self.cells[state] is not None:
                cost, node = self.cells[state]
                role, then = MADE[state]
                self._offer(then, cost + INSERT, node, Edit("I", None, role, ""))
        # whatever may follow SYSTEM may follow ASSISTANT; of START's futures only a kept system turn is more
        for state, more in ((SYSTEM, 0), (START, DELETE)):
            if self.cells[state] is not None and self.cells[state][0] > self.cells[ASSISTANT][0] + more:
                self.cells[state] = None

    def add(self, turn: Turn) -> list[Edit]:
        before, self.cells = self.cells, [None] * 4
        stay = CUT if turn.cut else 0
        for state, cell in enumerate(before):
            if cell is None:
                continue
            cost, node = cell
            self._offer(state, cost + DELETE, node, Edit("D", turn.turn, None, None))
            if turn.blank or turn.repeated:
                continue
            if (then := FOLLOWS[state].get(turn.role[:1])) is not None:
                self._offer(then, cost + KEEP + stay, node, Edit("K", turn.turn, turn.role, turn.text))
            role, then = MADE[state]
            self._offer(then, cost + REROLE + stay, node, Edit("R", turn.turn, role, turn.text))
        self._insert()
        self.seen += 1
        return self._settled() if self.seen % self.settle == 0 else []

    def _settled(self) -> list[Edit]:
        """What all audits share, which is then forgotten."""
        live = [(state, *cell) for state, cell in enumerate(self.cells) if cell is not None]
        root = live[0][2]
        for _, _, node in live[1:]:
            root = self.audits.shared(root, node)
        done = self.audits.trail(root)
        rests = [(state, cost, self.audits.trail(node, root)) for state, cost, node in live]
        self.audits.clear()
        children: dict[tuple[int, Edit], int] = {}
        for state, cost, rest in rests:
            node = 0
            for edit in rest:
                if (node, edit) not in children:
                    children[node, edit] = self.audits.extend(node, edit)
                node = children[node, edit]
            self.cells[state] = (cost, node)
        return done

    def finish(self) -> tuple[int, list[Edit]]:
        """The cost of all and the edits not given out yet."""
        best = None
        for state in ENDS:
            cell = self.cells[state]
            if cell and (best is None or cell[0] < best[0] or (cell[0] == best[0] and self.audits.less(cell[1], best[1]))):
                best = cell
        return best[0], self.audits.trail(best[1])


@dataclass
class Report:
    """What is known of a conversation after each of its turns and edits."""

    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
    first: int | None = None
    last: int | None = None
    turns: int = 0
    initial: str | None = None
    audit: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    kept: int = 0

    def read(self, turn: Turn) -> None:
        if turn.blank or turn.repeated or turn.cut:
            self.faults["blank" if turn.blank else "duplicate" if turn.repeated else "truncated"] += 1
        self.faults["illegal"] += self.initial is not None and self.initial + turn.role[:1] not in LEGAL
        self.initial = turn.role[:1]
        if turn.turn is not None and turn.turn != self.last:
            self.first, self.last, self.turns = turn.turn if self.first is None else self.first, turn.turn, self.turns + 1

    def write(self, edits: list[Edit]) -> None:
        self.audit.append("".join(e.initial for e in edits))
        for e in edits:
            if e.role is not None:
                self.digest.update(f"{chr(10) if self.kept else ''}{e.role}:{e.text}".encode())
                self.kept += 1

    def row(self, conv_id, cost: int) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": conv_id, "gaps": gaps, **self.faults, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "step long, edit string, turn long, role string, text string"


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Turns with their faults, each conversation in one partition and in order."""
    tidy = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.withColumns({"blank": tidy == "", "cut": ~F.substring(tidy, -1, 1).isin(".", "!", "?")})
    rows = rows.withColumn("_said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    said = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_same"))
    said = said.agg(F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_null"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same"))
    # of equal turns with the least number, the stream sees the first
    later = F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_least"))
    rows = rows.join(said, same).select("conv_id", "turn", "role", "text", "blank", later.alias("later"), "cut")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def read_turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, bool, Turn]]:
    """``(conversation, whether it begins, turn)`` of sorted batches."""
    at, before, begins = None, None, True
    for batch in batches:
        for conv_id, turn, role, text, blank, later, cut in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            begins = before is None or conv_id != at
            again = not begins and before == (turn, role, text)
            yield conv_id, begins, Turn(turn, role, text, blank, later or again, cut)
            at, before = conv_id, (turn, role, text)


def reports(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One report per conversation."""
    held = None
    for conv_id, begins, turn in read_turns(batches):
        if begins:
            if held:
                yield _close(*held)
            held = conv_id, Repair(), Report()
        held[2].read(turn)
        held[2].write(held[1].add(turn))
    if held:
        yield _close(*held)


def _close(conv_id, repair: Repair, report: Report) -> dict:
    cost, rest = repair.finish()
    report.write(rest)
    return report.row(conv_id, cost)


def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The edits of each conversation, in order."""
    conv, repair, step = None, None, 0

    def rows(found: list[Edit]) -> Iterator[dict]:
        nonlocal step
        for e in found:
            yield {"conv_id": conv, "step": step, "edit": e.initial, "turn": e.turn, "role": e.role, "text": e.text}
            step += 1

    for conv_id, begins, turn in read_turns(batches):
        if begins:
            if repair:
                yield from rows(repair.finish()[1])
            conv, repair, step = conv_id, Repair(), 0
        yield from rows(repair.add(turn))
    if repair:
        yield from rows(repair.finish()[1])


def _streamed(rows: DataFrame, produce, columns: str, size: int = 1000) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {columns}"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in produce(batches):
            held.append(row)
            if len(held) == size:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return ordered_turns(rows).mapInArrow(run, schema)


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The columns that repair reads; null role or text is one space."""
    rows = pick(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    space = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def repair_report(turns: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns, a row per conversation of :func:`turns_of`."""
    return _streamed(turns, reports, REPORT)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, step, edit, turn, role, text)``: every edit; role and text are those of the repaired turn, null where deleted."""
    return _streamed(turns, edits, EDITS)


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn``: of 20 rows one each is lost, emptied, cut, repeated, given to the user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.withColumn("_k", F.crc32(name.cast("binary")) % 20).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))})
    times = F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))
    return rows.withColumn("_n", F.explode(times)).drop("_k", "_n")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """The report of every conversation after :func:`damaged`; zeros and no audit where nothing is left."""
    turns = turns_of(rows)
    found = repair_report(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [c.split()[0] for c in REPORT.split(", ")[:6]]
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
