"""Conversation structure repair by Viterbi search with survivor coalescence.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its rows, in the order of
their turns, are kept, given another role or deleted, and rows may be inserted; each edit has a cost, and
the cheapest list of edits is wanted, of equally cheap ones the one whose initials come first in ASCII.

* The search goes row by row. For each state of the pattern (nothing yet, after ``s``, ``u``, ``a``) it
  keeps one *survivor*: the cheapest list of edits that leads there. The next role is always determined
  by the state, so a list of initials says all about a repair.
* Survivors are leaves of one tree of backpointers. A node counts what refers to it; one that nothing
  refers to is dropped, and so on up the tree. As soon as all survivors descend from one node, the edits
  up to it are final and leave the tree, so it only holds what is still undecided.
* A survivor that costs more than another one and whatever that other needs to go on like it is dropped.
* Survivors that cost the same are compared by all their undecided edits. Two lists of the same cost are
  never each other's beginning, since they deal with the same rows and inserted rows cost something; so
  what follows cannot change which comes first.

Rows are damaged and judged by DataFrame functions. Repeated turns are found by counting them by content
before they meet their conversation, hot ones dealt out. Rows then go to their conversation's task, sorted
there by Spark, and are streamed: of a conversation a task holds its undecided edits and one running hash
per survivor, no texts. (A hash over a whole conversation and its one string of edits have to be made in
one place; all else is spread by rows.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.operators.skew import spread_join
from estatelens.session import durable

#: ASCII white space.
BLANK = r"\x20\x09-\x0D"
#: Edits and what they do: Delete, Insert, Keep, Rerole.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: state -> (initial kept as it is -> next state), (role that may come, next state)
_KEPT = [{"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER}]
_ROLE = [("user", _USER), ("user", _USER), ("assistant", _ASSISTANT), ("user", _USER)]
_ACCEPTED = (_START, _ASSISTANT)


@dataclass(frozen=True)
class Costs:
    """What edits cost; ``truncated`` is added for a truncated row that stays. Inserts must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert < 1:
            raise ValueError("costs are not negative, and inserts cost at least 1")


# --- rows and their faults ------------------------------------------------------------------------------


def _slim(rows: DataFrame, conv: str, turn: str, role: str, text: str, there: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, there); a null role or text is one space."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    return rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        said(role).alias("role"),
        said(text).alias("text"),
        (F.lit(True) if there is None else F.coalesce(F.col(f"`{there}`"), F.lit(False))).alias("there"),
    )


def damage(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, text, there): the rows with made-up faults, by a checksum of conversation and turn.

    Of twenty checksums, 0 drops the row (it stays with ``there`` false, so that its conversation is known),
    1 empties its text, 2 takes its ends of sentences out, 3 repeats it and 4 makes it a user's. Null ids and
    turns enter the checksum as one space.
    """
    slim = _slim(rows, conv_col, turn_col, role_col, text_col)
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    return slim.withColumn("fault", fault).select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("fault") != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, there)`` with ``fault``: blank, duplicate, truncated or null.

    A row is a duplicate if an earlier one of its conversation has its role and text. Rows are counted by
    content; only contents that occur several times go back to their rows, each with its first turn.
    Of rows that agree in the turn too, all but one are duplicates; the stream sees which.
    """
    digest = F.sha2(F.concat_ws("\n", F.sha2("role", 256), F.sha2("text", 256)), 256)
    # nulls come first: a turn's rank is (is it there, turn)
    rank = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    content = rows.where("there").select(F.struct("conv_id").alias("conv"), digest.alias("digest"), rank.alias("rank"))
    repeated = (
        content.groupBy("conv", "digest").agg(F.min("rank").alias("first_rank"), F.count("*").alias("times"))
        .where("times > 1").drop("times")
    )
    keyed = rows.withColumns({"conv": F.struct("conv_id"), "digest": digest, "rank": rank})
    joined = spread_join(keyed, durable(repeated), ["conv", "digest"], "left")
    later = F.col("rank") > F.col("first_rank")
    last = F.regexp_extract("text", rf"([^{BLANK}])[{BLANK}]*\z", 1)
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "there",
        F.when(last == "", "blank").when(later, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
        F.col("first_rank").isNotNull().alias("repeated"),
    )


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


# --- the search -----------------------------------------------------------------------------------------


class _Node:
    """One edit in the tree; it is referred to by the edits after it and, at a leaf, by its survivor."""

    __slots__ = ("before", "edit", "at", "after", "held")

    def __init__(self, before: _Node | None, edit: str, at: int):
        self.before, self.edit, self.at = before, edit, at
        self.after: list[_Node] = []
        self.held = 1
        if before is not None:
            before.after.append(self)

    def references(self) -> int:
        return len(self.after) + self.held

    def release(self) -> None:
        """Its survivor is gone; edits that nothing refers to any more leave the tree."""
        self.held -= 1
        node = self
        while node.references() == 0 and node.before is not None:
            node.before.after.remove(node)
            node = node.before


@dataclass
class _Survivor:
    """``rank`` orders the survivors' edits up to the last row, ``inserts`` have been made since."""

    cost: int
    rank: int
    inserts: int
    node: _Node
    carried: object

    def key(self, more: int = 0, edit: str = "") -> tuple:
        """Where it stands among all offers: by cost, then by its whole list of edits."""
        return (self.cost + more, self.rank, INSERT * self.inserts + edit)


class Search:
    """The repair of one conversation, fed row by row.

    ``emit(edit, at)`` gets the edits as they become final; ``at`` is the number of the row, or of the row
    before which one is inserted. ``start`` is what a survivor carries
    beside its edits, and ``carry(carried, role, text)`` what it carries after one more repaired row.

    Which of two survivors' undecided edits come first is settled where they part. Their order is carried
    along as a rank, so that whole lists are compared at every tie without walking them.
    """

    def __init__(self, costs: Costs, emit: Callable, start=None, carry: Callable = lambda carried, role, text: carried):
        self.costs, self.emit, self.carry = costs, emit, carry
        self.rows = 0
        self.root = _Node(None, "", -1)
        self.alive: list[_Survivor | None] = [_Survivor(0, 0, 0, self.root, start), None, None, None]
        c = costs
        #: what it costs at most to go on from x as if from y
        self.bridge = {
            (_START, _SYSTEM): 0, (_START, _USER): c.insert, (_START, _ASSISTANT): 0,
            (_SYSTEM, _START): 2 * c.insert + c.delete, (_SYSTEM, _USER): c.insert, (_SYSTEM, _ASSISTANT): 2 * c.insert,
            (_USER, _START): c.insert + c.delete, (_USER, _SYSTEM): c.insert, (_USER, _ASSISTANT): c.insert,
            (_ASSISTANT, _START): c.delete, (_ASSISTANT, _SYSTEM): 0, (_ASSISTANT, _USER): c.insert,
        }
        self._insert()

    def row(self, role: str, text: str, fault: str | None) -> None:
        """The next row."""
        costs = self.costs
        stays = fault not in ("blank", "duplicate")
        extra = costs.truncated if fault == "truncated" else 0
        best: list = [None] * 4  # by state: (key, survivor it goes on from, edit, role of the repaired row)

        def offer(to: int, survivor: _Survivor, more: int, edit: str, said: str | None) -> None:
            key = survivor.key(more, edit)
            if best[to] is None or key < best[to][0]:
                best[to] = (key, survivor, edit, said)

        for state, survivor in enumerate(self.alive):
            if survivor is None:
                continue
            offer(state, survivor, costs.delete, DELETE, None)
            if stays:
                kept = _KEPT[state].get(role[:1])
                if kept is not None:
                    offer(kept, survivor, extra, KEEP, role)
                other, to = _ROLE[state]
                offer(to, survivor, extra + costs.rerole, REROLE, other)
        self._advance(best, text)
        self.rows += 1
        self._insert()
        self._prune()
        self._settle()

    def finish(self) -> tuple[int, object]:
        """Emits all edits that are left; returns the cost and what the repair carries."""
        best = min((s for s in (self.alive[a] for a in _ACCEPTED) if s is not None), key=_Survivor.key)
        path, node = [], best.node
        while node is not self.root:
            path.append(node)
            node = node.before
        for node in reversed(path):
            self.emit(node.edit, node.at)
        return best.cost, best.carried

    def undecided(self) -> int:
        """Edits in the tree."""
        todo, n = list(self.root.after), 0
        while todo:
            n += 1
            todo.extend(todo.pop().after)
        return n

    def _advance(self, best: list, text: str) -> None:
        offers = [(to, o) for to, o in enumerate(best) if o is not None]
        order = sorted(range(len(offers)), key=lambda i: offers[i][1][0][1:])
        rank = {i: r for r, i in enumerate(order)}
        now: list[_Survivor | None] = [None] * 4
        for i, (to, (key, survivor, edit, role)) in enumerate(offers):
            carried = survivor.carried if role is None else self.carry(survivor.carried, role, text)
            now[to] = _Survivor(key[0], rank[i], 0, _Node(survivor.node, edit, self.rows), carried)
        gone, self.alive = self.alive, now
        for survivor in gone:
            if survivor is not None:
                survivor.node.release()

    def _insert(self) -> None:
        """Rows inserted before the next one: a survivor may go on to another state where it is better there."""
        changed = True
        while changed:
            changed = False
            for state in range(4):
                survivor = self.alive[state]
                if survivor is None:
                    continue
                role, to = _ROLE[state]
                there = self.alive[to]
                if there is None or survivor.key(self.costs.insert, INSERT) < there.key():
                    carried = self.carry(survivor.carried, role, "")
                    node = _Node(survivor.node, INSERT, self.rows)
                    cost = survivor.cost + self.costs.insert
                    self.alive[to] = _Survivor(cost, survivor.rank, survivor.inserts + 1, node, carried)
                    if there is not None:
                        there.node.release()
                    changed = True

    def _prune(self) -> None:
        """Drop survivors that are dearer than another with all it takes to go on like them."""
        for y, dear in enumerate(self.alive):
            if dear is None:
                continue
            for x, cheap in enumerate(self.alive):
                if x != y and cheap is not None and cheap.cost + self.bridge[x, y] < dear.cost:
                    self.alive[y] = None
                    dear.node.release()
                    break

    def _settle(self) -> None:
        """Emit the edits that all survivors share: down from the root while there is one way only."""
        root = self.root
        while len(root.after) == 1 and not root.held:
            root = root.after[0]
            self.emit(root.edit, root.at)
            root.before = None
        self.root = root


# --- the operators --------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(first row of its group?, row) of batches sorted by their first ``keys`` columns."""
    last = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield last is None or row[:keys] != last, row
            last = row[:keys]


@dataclass
class _Report:
    """Counts over the rows of one conversation."""

    conv: int | None
    least: int | None = None
    most: int | None = None
    turns: int = 0
    illegal: int = 0
    initial: str | None = None
    row: tuple | None = None

    def __post_init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []

    def see(self, turn: int | None, role: str, fault: str | None) -> None:
        if fault is not None:
            self.faults[fault] += 1
        if turn is not None:
            if turn != self.most:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]

    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns


def _fault(row: tuple, before: tuple | None) -> str | None:
    """The fault of a sorted row (turn, role, text, fault, repeated): equal neighbours are duplicates."""
    turn, role, text, fault, repeated = row
    if repeated and fault != "blank" and before is not None and (turn, role, text) == before[:3]:
        return "duplicate"
    return fault


def _hashed(carried, role: str, text: str):
    digest, rows = carried
    digest = digest.copy()
    digest.update(("\n" * (rows > 0) + role + ":" + text).encode())
    return digest, rows + 1


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _in_order(judged: DataFrame) -> DataFrame:
    """Each conversation in one partition, its rows in order; Spark sorts, and spills if it has to."""
    return judged.repartition("conv_id").sortWithinPartitions(*_order())


def audit_conversations(
    rows: DataFrame,
    costs: Costs = Costs(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there_col: str | None = None,
) -> DataFrame:
    """Per conversation: its faults, what the cheapest repair costs, its edits, and a hash of what comes out.

    ``gaps`` are missing numbers between the least and the greatest turn, ``illegal`` neighbours that no well
    formed conversation has. A row has one fault: blank, else duplicate (role and text as in an earlier row),
    else truncated (its last sign ends no sentence). Rows stand in the order of turns, nulls first, rows of one
    turn by role and text; repeated rows are duplicates. Rows without a conversation are one conversation.
    Null roles and texts are one space: a role without a meaning, and a blank text. Rows whose ``there_col`` is
    not true only say that their conversation exists; one without other rows has zeros, no edits and the hash
    of the empty text. Empty texts are blank; of long ones only hashes are kept. An empty table gives no rows.
    Further columns, of any name, are not looked at.
    """
    slim = _slim(rows, conv_col, turn_col, role_col, text_col, there_col)
    slim = _in_order(_judged(slim)).select("conv_id", "there", "turn", "role", "text", "fault", "repeated")

    def repair(batches):
        done: list[tuple] = []
        report = search = None

        def close():
            cost, (digest, _) = search.finish()
            faults = report.faults
            done.append((
                report.conv, report.gaps(), faults["blank"], faults["duplicate"], faults["truncated"], report.illegal,
                cost, "".join(report.audit), digest.hexdigest(),
            ))

        def flush():
            kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
            names = [part.split()[0] for part in REPORT.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done.clear()
            return out

        for first, (conv, there, *row) in _groups(batches, 1):
            if first:
                if report is not None:
                    close()
                if len(done) >= 1000:
                    yield flush()
                report = _Report(conv)
                edits = report.audit
                search = Search(costs, lambda edit, at, edits=edits: edits.append(edit), (hashlib.sha256(), 0), _hashed)
            if there:
                row = tuple(row)
                fault = _fault(row, report.row)
                report.see(row[0], row[1], fault)
                search.row(row[1], row[2], fault)
                report.row = row
        if report is not None:
            close()
        if done:
            yield flush()

    return slim.mapInArrow(repair, REPORT)


def repair_conversations(
    rows: DataFrame,
    costs: Costs = Costs(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The repaired rows: (conv_id, step, edit, turn, role, text), ``step`` counting from 0 in each conversation.

    Deleted rows are left out, inserted ones have no turn and an empty text. Which rows are faulty, and what
    nulls, repeated rows, empty and long texts give, is as in ``audit_conversations``. The search sees roles
    and faults only and writes each edit as soon as it is final; texts meet their edits in a join.
    """
    slim = _slim(rows, conv_col, turn_col, role_col, text_col, None)
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order()[1:])) - 1
    digest = F.sha2(F.concat_ws("\n", F.sha2("role", 256), "text"), 256)
    numbered = durable(_judged(slim).withColumns({"at": at.cast("long"), "digest": digest}))
    stream = (
        numbered.select("conv_id", "at", "turn", "role", "digest", "fault", "repeated")
        .repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")
    )

    def edits(batches):
        done: list[tuple] = []
        search = conv = before = None

        def opened(conv):
            step = iter(range(1 << 62))
            return Search(costs, lambda edit, at: done.append((conv, next(step), edit, at)))

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv_id", "edit_no", "edit", "at"]
            )
            done.clear()
            return out

        for first, (conv, _, *row) in _groups(batches, 1):
            if first:
                if search is not None:
                    search.finish()
                search, before = opened(conv), None
            row = tuple(row)
            search.row(row[1], "", _fault(row, before))
            before = row
            if len(done) >= 1000:
                yield flush()
        if search is not None:
            search.finish()
        if done:
            yield flush()

    made = durable(stream.mapInArrow(edits, "conv_id long, edit_no long, edit string, at long"))
    known = numbered.select(F.struct("conv_id").alias("conv"), "at", "turn", "role", "text")
    left = made.where(F.col("edit") != DELETE).withColumn("conv", F.struct("conv_id"))
    joined = left.join(known, ["conv", "at"], "left")
    fresh = F.col("edit") == INSERT
    by_conv = Window.partitionBy("conv_id").orderBy("edit_no")
    step = (F.row_number().over(by_conv) - 1).cast("long")
    first_is_system = F.first(F.when(F.col("edit") == KEEP, F.substring("role", 1, 1)) == "s").over(
        by_conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordinal = step - F.when(first_is_system, 1).otherwise(0)
    said = F.when(F.col("edit") == KEEP, F.col("role")).otherwise(
        F.when(ordinal % 2 == 0, "user").otherwise("assistant")
    )
    return joined.select(
        "conv_id",
        step.alias("step"),
        "edit",
        F.when(~fresh, F.col("turn")).alias("turn"),
        said.alias("role"),
        F.when(fresh, "").otherwise(F.col("text")).alias("text"),
    )
