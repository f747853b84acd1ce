"""Conversations repaired at the least cost: a backward cost-to-go table, then a forward walk along cost-tight edits.

A repaired conversation's role initials are nothing or an optional ``s`` and then pairs ``ua``. Edits: Keep (0), Rerole to user or
assistant (2), Delete (3, the only one for blank and repeated turns), Insert an empty turn (2); a truncated turn that stays adds 1.
What an inserted or reroled turn becomes follows from the grammar's state, so the edits' initials fix the repaired turns.

The work is one shuffle by conversation and three sorts inside the partitions: repeats are marked by a window, costs are carried
from the last turn to the first, then the walk goes from the first to the last. Both passes are streams over Arrow batches that
keep one conversation's state (four costs; counts, a running hash and the edits' initials so far), so that memory does not grow with
a conversation's texts. A conversation's turns are read in order by one task, however many: its hash is a chain over all of them.

Nulls: a null role or text is one space, a null turn comes first and a null conversation is one of its own; neither takes part in
gaps. Empty texts are blank; an empty role, like any that starts with no s, u or a, must be reroled or deleted. Turns that tie are
taken by role and text. Rows of which nothing is left give zeros, empty edits and the empty text's hash; an empty table has no rows.
Columns beyond the four named ones are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlark.llm.common import bounded

SPACES = " \t\n\x0b\f\r"
#: States of the grammar: nothing yet, after s, after u, after a. What each state takes next, and where an inserted turn leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_FORWARD = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The cost of ending in each state, all turns read: only nothing and a finished pair are whole.
_END = (0, 4, 2, 0)
_KEEP, _REROLE, _DELETE, _INSERT, _CUT_OFF = 0, 2, 3, 2, 1
_NEVER = 1 << 60

_MARKED = "conv_id bigint, turn bigint, role string, text string, dropped boolean, nth int, fault int"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damage(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> the same with dropped; each row's damage follows from crc32 of conv_id:turn modulo 20:
    0 drops it (the row stays, marked), 1 empties its text, 2 takes out [.!?], 3 repeats it, 4 makes its role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def mark_faults(turns: DataFrame) -> DataFrame:
    """Adds each row's first fault: 1 blank, 2 role and text seen earlier in the conversation, 3 truncated, else 0; and nth, its
    place among the conversation's rows of its role and text. Rows are dealt by conversation."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    earlier = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(end == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return turns.repartition("conv_id").withColumn("nth", F.row_number().over(earlier)).withColumn("fault", fault).select("conv_id", "turn", "role", "text", "dropped", "nth", "fault")


def _ways(after: tuple, initial: str, fault: int) -> tuple:
    """The least cost from each state at a turn, given the costs after it."""
    own = [_DELETE + after[q] for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = _CUT_OFF if fault == TRUNCATED else 0
        for q in range(4):
            own[q] = min(own[q], more + _KEEP + (after[_TAKES[q][initial]] if initial in _TAKES[q] else _NEVER), more + _REROLE + after[_FORWARD[q]])
    user, assistant = min(own[USER], _INSERT + own[ASSISTANT]), min(own[ASSISTANT], _INSERT + own[USER])
    return min(own[START], _INSERT + user), min(own[SYSTEM], _INSERT + user), user, assistant


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last turn to the first -> with the costs after each row."""
    of, costs = object(), _END
    for batch in batches:
        after = []
        for conv, role, dropped, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "dropped", "fault"))):
            if conv != of:
                of, costs = conv, _END
            after.append(costs)
            if not dropped:
                costs = _ways(costs, role[:1], fault)
        columns = [pa.array([c[q] for c in after], pa.int64()) for q in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "c0", "c1", "c2", "c3"])


class _Walk:
    """One conversation on its way from the first turn to the last."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.edits, self.hash, self.any = conv, START, bytearray(), hashlib.sha256(), False
        self.faults, self.illegal, self.cost, self.before = [0, 0, 0, 0], 0, None, None
        self.low = self.high = None
        self.turns = 0

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _insert(self) -> None:
        self.state = _FORWARD[self.state]
        self.edits += b"I"
        self._put(_ROLE[self.state], "")

    def step(self, turn: int | None, role: str, text: str, fault: int, after: tuple) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        here = _ways(after, initial, fault)
        if self.cost is None:
            self.cost = here[START]
        stays, more = fault not in (BLANK, DUPLICATE), _CUT_OFF if fault == TRUNCATED else 0
        while True:  # the smallest letter among the edits that keep to the least cost
            q, least = self.state, here[self.state]
            if _DELETE + after[q] == least:
                self.edits += b"D"
                return
            if _INSERT + here[_FORWARD[q]] == least:
                self._insert()
                continue
            if stays and initial in _TAKES[q] and more + _KEEP + after[_TAKES[q][initial]] == least:
                self.edits += b"K"
                self.state = _TAKES[q][initial]
                self._put(role, text)
            else:
                self.edits += b"R"
                self.state = _FORWARD[q]
                self._put(_ROLE[self.state], text)
            return

    def row(self) -> tuple:
        while _END[self.state]:
            self._insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost or 0, self.edits.decode(), self.hash.hexdigest()


_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = None
    for batch in batches:
        done = []
        for conv, turn, role, text, dropped, _, fault, *after in zip(*(c.to_pylist() for c in batch.columns)):
            if walk is None or conv != walk.conv:
                if walk is not None:
                    done.append(walk.row())
                walk = _Walk(conv)
            if not dropped:
                walk.step(turn, role, text, fault, tuple(after))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _ARROW)], schema=_ARROW)
    if walk is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(walk.row(), _ARROW)], schema=_ARROW)


def repair(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, dropped) -> one row a conversation: what was wrong, the least cost, the edits, the repaired turns' hash."""
    marked = bounded(mark_faults(turns))
    place = [F.col("role"), F.col("text"), F.col("nth")]  # equal rows keep one order in both passes
    last_first = marked.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), *(c.desc() for c in place))
    costs = last_first.mapInArrow(_backward, f"{_MARKED}, c0 bigint, c1 bigint, c2 bigint, c3 bigint")
    return costs.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), *(c.asc() for c in place)).mapInArrow(_forward, _RESULT)
