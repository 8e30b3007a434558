"""Cheapest repair of conversations: Viterbi over role orders, edits emitted as survivors coalesce."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of a role leads from each state, and the role that a rerole or an insert adds there.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
KEPT, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert <= 0:
            raise ValueError("costs must not be negative, and an insert must cost something")

    def lead(self) -> dict[tuple[int, int], int]:
        """For states (y, x), at most how much more the rest costs from y than from x."""
        i, d = self.insert, self.delete
        return {
            (ASSISTANT, SYSTEM): 0, (START, SYSTEM): 0, (START, ASSISTANT): 0, (ASSISTANT, START): d, (SYSTEM, ASSISTANT): 2 * i,
            (SYSTEM, START): max(d, 2 * i), (USER, ASSISTANT): i, (USER, START): i + d, (USER, SYSTEM): i,
            (ASSISTANT, USER): i, (START, USER): i, (SYSTEM, USER): i,
        }


class Node:
    """One survivor's edits at one row. Live as long as a later node or a survivor refers to it."""

    __slots__ = ("parent", "letters", "refs", "level")

    def __init__(self, parent: Node | None, letters: str, level: int):
        self.parent, self.letters, self.refs, self.level = parent, letters, 1, level
        if parent:
            parent.refs += 1


def _compare(a: str, b: str) -> int | tuple[str, str]:
    """Order of two strings: -1 or 1, or, if one begins the other, what each has left."""
    n = min(len(a), len(b))
    if a[:n] != b[:n]:
        return -1 if a < b else 1
    return a[n:], b[n:]


class Repair:
    """Viterbi over one conversation, fed row by row.

    The survivors of the four states are leaves of a tree of backpointers. A node that no survivor
    reaches any more is released with the chain above it that nothing else refers to; once a level holds one live
    node, all survivors share it, and its edits are final: they are emitted and the tree starts below. Survivors that
    cost more than another by more than the rest can ever win back are dropped, so that dead ends
    don't hold the tree. Only unresolved edits are held, no texts: each survivor
    carries the running digest of its own repaired conversation.

    Among equal costs the ASCII-least edits win, over their complete unresolved suffixes: how the
    suffixes of two survivors compare was decided at the first edit in which they differ, so this order is kept
    per pair and only the new edits are compared.
    """

    def __init__(self, costs: Costs = Costs()):
        self.costs, self.lead = costs, costs.lead()
        self.final: list[str] = []
        self.levels: deque[set[Node]] = deque()
        self.first = 0
        root = Node(None, "", -1)
        self.order: dict = {}
        self.alive = {START: (0, root, hashlib.sha256())}
        self._advance({START: [(0, START, "", None)]})

    def row(self, role: str, text: str, fault: int) -> None:
        """The next row: kept, reroled or deleted, with inserts after it."""
        c, ways = self.costs, {}
        extra = c.truncated if fault == TRUNCATED else 0
        for state, (cost, _, _) in self.alive.items():
            ways.setdefault(state, []).append((cost + c.delete, state, "D", None))
            if fault in (BLANK, DUPLICATE):
                continue
            to = FOLLOWS.get((state, role[:1]))
            if to is not None:
                ways.setdefault(to, []).append((cost + extra, state, "K", (role, text)))
            to, name = NEXT[state]
            ways.setdefault(to, []).append((cost + c.rerole + extra, state, "R", (name, text)))
        self._advance(ways)

    def _related(self, a: tuple[int, str], b: tuple[int, str]):
        """Order of two candidates (state before, new letters)."""
        if a[0] == b[0]:
            return _compare(a[1], b[1])
        known = self.order[a[0], b[0]]
        return known if isinstance(known, int) else _compare(known[0] + a[1], known[1] + b[1])

    def _less(self, a: tuple, b: tuple) -> bool:
        """Whether candidate a (cost, state before, letters, rows) beats b."""
        if a[0] != b[0]:
            return a[0] < b[0]
        found = self._related(a[1:3], b[1:3])
        return found == -1 if isinstance(found, int) else len(found[0]) < len(found[1])

    def _advance(self, ways: dict) -> None:
        best: dict[int, tuple] = {}
        for state, options in ways.items():
            for cost, came, letter, line in options:
                option = (cost, came, letter, (line,) if line else ())
                if state not in best or self._less(option, best[state]):
                    best[state] = option
        # Inserts, until none helps; each costs something.
        changed = True
        while changed:
            changed = False
            for state in list(best):
                cost, came, letters, lines = best[state]
                to, name = NEXT[state]
                option = (cost + self.costs.insert, came, letters + "I", (*lines, (name, "")))
                if to not in best or self._less(option, best[to]):
                    best[to], changed = option, True
        best = {
            x: way for x, way in best.items() if all(way[0] <= best[y][0] + self.lead[y, x] for y in best if y != x)
        }
        level, new, before = self.first + len(self.levels), {}, self.alive
        self.levels.append(set())
        for state, (cost, came, letters, lines) in best.items():
            node = Node(before[came][1], letters, level)
            self.levels[-1].add(node)
            digest = before[came][2]
            if lines:
                digest = digest.copy()
                empty = came == START
                for role, text in lines:
                    digest.update(((("" if empty else "\n") + role + ":" + text)).encode())
                    empty = False
            new[state] = (cost, node, digest)
        states = list(new)
        self.order = {(x, y): self._related(best[x][1:3], best[y][1:3]) for x in states for y in states if x != y} if len(states) > 1 else {}
        self.alive = new
        for _, node, _ in before.values():
            self._release(node)
        while self.levels and len(self.levels[0]) == 1:
            (shared,) = self.levels.popleft()
            self.final.append(shared.letters)
            shared.parent, shared.letters = None, ""
            self.first += 1

    def _release(self, node: Node | None) -> None:
        while node:
            node.refs -= 1
            if node.refs:
                return
            if node.level >= self.first:
                self.levels[node.level - self.first].discard(node)
            node = node.parent

    def unresolved(self) -> int:
        """Live nodes whose edits are not final."""
        return sum(len(x) for x in self.levels)

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the cheapest repair."""
        ends = [(cost, came, "", ()) for came, (cost, _, _) in self.alive.items() if came in (START, ASSISTANT)]
        best = ends[0]
        for option in ends[1:]:
            if self._less(option, best):
                best = option
        _, node, digest = self.alive[best[1]]
        tail = []
        while node:
            tail.append(node.letters)
            node = node.parent
        return best[0], "".join(self.final) + "".join(reversed(tail)), digest.hexdigest()


class _Conversation:
    """Counts and repair of one conversation, fed in order."""

    def __init__(self, costs: Costs):
        self.repair, self.faults, self.illegal = Repair(costs), [0, 0, 0, 0], 0
        self.last, self.low, self.high, self.turns, self.rows = None, None, None, 0, 0

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows += 1
        self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.rows, gaps, *self.faults[1:], self.illegal, *self.repair.end())


def _repaired(batches: Iterator[pa.RecordBatch], costs: Costs, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations of one partition, in order, whatever batches they lie across."""
    done: list[tuple] = []
    talk, name = None, None
    for batch in batches:
        for conv, turn, role, text, fault, present in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "fault", "present"))):
            if talk is None or conv != name:
                if talk is not None:
                    done.append((name, *talk.result()))
                talk, name = _Conversation(costs), conv
            if present:
                talk.row(turn, role, text, fault)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)
            done = []
    if talk is not None:
        done.append((name, *talk.result()))
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)


def repair_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
    costs: Costs = Costs(),
) -> DataFrame:
    """The cheapest edits that give each conversation roles of initials ``(s?(ua)+)?``.

    One row per key: ``key``, n_rows, gaps (missing turn numbers), blank, duplicate, truncated (rows by
    their first fault), illegal (adjacent role initials other than su, ua, au), cost, audit (initials of
    the edits Keep, Rerole, Delete, Insert in order; among equal costs the ASCII-least) and
    repaired_sha256 (of the repaired ``role:text`` lines). ``repaired_rows`` applies an audit.

    A row is blank without a character outside white space, a duplicate if its role and text came earlier, truncated
    if its last such character is none of ``.!?``. Blank and duplicate rows must be deleted; a truncated row costs more unless it is.

    One shuffle, by key. Inside a task two sorts, which spill: the first finds repeats (a running count per role and
    text), the second puts rows into turn order, and the Viterbi pass of ``Repair`` streams over them with no conversation held. A
    conversation is one task's, as each edit depends on all before it; its memory is that of its unresolved edits and its audit.

    Rows go by turn, null turns first; rows of one turn by role, then text. Null roles and texts count as one space; a
    null key is a conversation. Rows whose ``present`` is not true only name their conversation; one without other
    rows gets zeros, an empty audit and the digest of nothing. Very long texts pass one at a time; an empty table gives no
    rows; other columns are ignored.
    """
    value = {c: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for c, name in (("role", role), ("text", text))}
    there = F.coalesce(F.col(present).cast("boolean"), F.lit(False)) if present else F.lit(True)
    data = rows.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), value["role"].alias("role"), value["text"].alias("text"), there.alias("present"))
    data = data.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy("turn"))
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(core == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(KEPT)
    data = data.withColumn("copy", seen).withColumn("fault", fault)
    data = data.sortWithinPartitions("conv", "turn", "role", "text", "copy").select("conv", "turn", "role", "text", "fault", "present")
    counts = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    shape = f"conv {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first["conv"].type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def again():
            yield first
            yield from batches

        yield from _repaired(again(), costs, schema)

    return data.mapInArrow(run, shape).withColumnRenamed("conv", key)


def repaired_rows(rows: DataFrame, audits: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of the repaired conversations: ``key``, place (from 0), edit, role, text.

    Each letter of an audit finds its row by number (inserts have none). The role of an added or
    changed row alternates from the last row of its conversation before it.
    """
    letters = audits.select(F.col(key).alias("conv"), F.posexplode(F.split("audit", "")).alias("i", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv").orderBy("i")
    letters = letters.withColumn("n", F.sum((F.col("edit") != "I").cast("long")).over(upto)).where("edit <> 'D'")
    value = {c: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for c, name in (("role", role), ("text", text))}
    own = rows.select(F.col(key).alias("own"), F.col(turn).cast("long").alias("turn"), value["role"].alias("was"), value["text"].alias("text"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("own").orderBy("turn", "was", "text")))
    own = own.withColumnRenamed("n", "number")
    same = F.col("conv").eqNullSafe(F.col("own")) & (F.col("n") == F.col("number")) & (F.col("edit") != "I")
    out = letters.join(own, same, "left")
    # A system row can only stand first, so the other roles alternate by place.
    place = F.row_number().over(upto) - 1
    led = F.max((F.col("edit") == "K") & (F.substring("was", 1, 1) == "s")).over(Window.partitionBy("conv")).cast("int")
    out = out.withColumn("place", place.cast("long")).withColumn("led", led)
    named = F.when((F.col("place") - F.col("led")) % 2 == 0, "user").otherwise("assistant")
    return out.select(
        F.col("conv").alias(key), "place", "edit", F.when(F.col("edit") == "K", F.col("was")).otherwise(named).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
