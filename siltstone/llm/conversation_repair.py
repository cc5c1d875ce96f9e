"""Repair of conversations whose turns don't alternate: the cheapest edits that make the roles `(s?(ua)+)?`, by a forward Viterbi pass.

Rows are (conv_id, turn, role, text). A conversation's rows come to one task in the order of turn (nulls first), role and text, sorted by Spark on disk, and pass
it as a stream. Four states of the grammar (nothing yet, after system, after user, after assistant) carry the least (cost, audit string); each row
makes a new layer by Keep, Rerole and Delete, which insertions close. Two audits of one state and cost never begin with each other (both hold one letter for each
row, and a further I costs), so the least beginning is that of the least whole. What all states' audits have in common is settled: its edits go out
as rows, and only rows behind that are held. So a conversation of any length needs little memory while its states agree on how it began, as they
soon do. Its rows are one task's all the same: a chain of edits, and a hash over the whole text in order, can't be computed in parts.

Cases: a null role or text is one space. A role that begins with neither s, u nor a (empty ones too) can't be kept. Rows equal in turn, role and text are
duplicates but for one. A null conv_id is a conversation like any other, and a null turn comes first and counts in no gap. Rows that tie in turn are in the order of role and text (UTF-8).
Empty tables give no rows; columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import text_places, trimmed

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: The state after a user's or assistant's turn that is inserted or made by another role, and after a kept row by its initial.
TURNED = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"
#: Rows that are held before the states' audits are compared for what they share, and rows of a batch that goes out.
HELD, ROWS = 64, 2048
_EDITS = "place long, turn long, was string, fault string, edit string, role string, text string, cost int"


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes the marks of its sentences' ends, 3 repeats it, 4 makes
    its role user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _fault(text: Column, seen: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated or none (empty)."""
    filled = F.rtrim(text, F.lit(_SPACE))
    return F.when(filled == "", "blank").when(seen, "duplicate").when(~F.substring(filled, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


class Repair:
    """The layers of one conversation. push() takes a row's initial, fault and size, settled() gives edits that are certain."""

    def __init__(self):
        self.layer = self._closed([(0, ""), None, None, None])
        self.state, self.rows, self.limit = START, deque(), HELD

    @staticmethod
    def _closed(layer: list) -> list:
        """Insertions of user and assistant turns: at most two on end, as a third only comes back at a higher cost. What can't win any more goes:
        all that follows `system` may follow an assistant's turn as well, and of what follows the start only a kept `system` may not, which a deletion replaces."""
        for state in (START, SYSTEM, USER, ASSISTANT):
            if layer[state] is not None:
                cost, audit = layer[state]
                to, new = TURNED[state], (cost + INSERT, audit + "I")
                if layer[to] is None or new < layer[to]:
                    layer[to] = new
        least = layer[ASSISTANT][0]
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if layer[state] is not None and layer[state][0] > least + more:
                layer[state] = None
        return layer

    def push(self, row: tuple) -> None:
        """row: (turn, role, text, fault)."""
        initial, fault, layer = row[1][:1], row[3], [None] * 4
        extra = TRUNCATED if fault == "truncated" else 0
        for state, at in enumerate(self.layer):
            if at is None:
                continue
            cost, audit = at
            options = [(state, (cost + DELETE, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                options.append((TURNED[state], (cost + REROLE + extra, audit + "R")))
                if (state, initial) in KEPT:
                    options.append((KEPT[state, initial], (cost + extra, audit + "K")))
            for to, new in options:
                if layer[to] is None or new < layer[to]:
                    layer[to] = new
        self.layer = self._closed(layer)
        self.rows.append(row)

    def settled(self):
        """Edits that all states share, once HELD rows wait; where they share little, twice as many have to wait next time."""
        if len(self.rows) >= self.limit:
            shared = os.path.commonprefix([at[1] for at in self.layer if at is not None])
            self.layer = [at and (at[0], at[1][len(shared) :]) for at in self.layer]
            yield from self._edits(shared)
            self.limit = HELD + 2 * len(self.rows)

    def ended(self):
        """The edits that are left: the least of the states that a conversation may end in."""
        yield from self._edits(min(at for at in (self.layer[START], self.layer[ASSISTANT]) if at is not None)[1])

    def _edits(self, letters: str):
        """(turn, role before, fault, edit, role, text, cost) of each letter."""
        for edit in letters:
            if edit == "I":
                self.state = TURNED[self.state]
                yield None, None, None, edit, NAMES[self.state], "", INSERT
                continue
            turn, role, text, fault = self.rows.popleft()
            cost, name = TRUNCATED if fault == "truncated" else 0, role
            if edit == "D":
                cost = DELETE
            elif edit == "R":
                self.state = TURNED[self.state]
                cost, name = cost + REROLE, NAMES[self.state]
            else:
                self.state = KEPT[self.state, role[:1]]
            yield turn, role, fault, edit, name, text, cost


_NOTHING = object()


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, was, fault, edit, role, text, cost): the cheapest edits of every conversation in order (of equal cost, those whose initials come first), K
    and R rows as they stay, I rows as they come in, D rows as they go. was: the role before, null for I. Partitions hold whole conversations in order."""
    kind = conversations.schema["conv_id"].dataType
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text")).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("nth", F.row_number().over(alike))  # the same partitions: no shuffle beyond the first
    rows = rows.select("conv_id", "turn", "role", "text", _fault(F.col("text"), F.col("nth") > 1).alias("fault"), "nth").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")

    @trimmed
    def run(batches):
        conv, repair, place, out, type_ = _NOTHING, None, 0, [], None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())

        def gone():
            names = ["conv_id", *(x.split()[0] for x in _EDITS.split(", "))]
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], type_), *(pa.array([r[i + 1] for r in out], k) for i, k in enumerate(kinds))], names=names)
            out.clear()
            return made

        def put(edits):
            nonlocal place, held
            for e in edits:
                out.append((conv, place, *e))
                place, held = place + 1, held + len(e[5])
                if len(out) >= ROWS or held > 4 << 20:
                    yield gone()
                    held = 0

        held = 0
        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for a, b in text_places(batch.column("text")):
                part = batch.slice(a, b - a)
                for c, *row in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                    if repair is None or c != conv:
                        if repair is not None:
                            yield from put(repair.ended())
                        conv, repair, place = c, Repair(), 0
                    repair.push(tuple(row))
                    yield from put(repair.settled())
        if repair is not None:
            yield from put(repair.ended())
        if out:
            yield gone()

    return rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, f"conv_id {kind.simpleString()}, {_EDITS}")


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of repaired(), read as it lies: gaps, blank, duplicate, truncated, illegal (adjacent roles before, neither su, ua nor au),
    cost, audit and repaired_sha256 (of `role:text` lines of the rows that stay)."""
    kind = edits.schema["conv_id"].dataType
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    @trimmed
    def run(batches):
        conv, now, out, type_ = _NOTHING, None, [], None

        def gone():
            made = pa.RecordBatch.from_arrays([pa.array([r["conv_id"] for r in out], type_), *(pa.array([r[n] for r in out], pa.int64()) for n in numbers), *(pa.array([r[n] for r in out], pa.string()) for n in ("audit", "repaired_sha256"))], names=["conv_id", *numbers, "audit", "repaired_sha256"])
            out.clear()
            return made

        def finished():
            now["audit"], now["repaired_sha256"] = "".join(now["letters"]), now["sha"].hexdigest()
            now["gaps"] = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            out.append(now)

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for a, b in text_places(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for c, turn, was, fault, edit, role, cost, text in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "was", "fault", "edit", "role", "cost")), texts, strict=True):
                    if now is None or c != conv:
                        if now is not None:
                            finished()
                            if len(out) >= ROWS:
                                yield gone()
                        conv, now = c, {"conv_id": c, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "letters": [], "sha": hashlib.sha256(), "turns": 0, "first": None, "last": None, "role": None, "any": False}
                    now["cost"] += cost
                    now["letters"].append(edit)
                    if edit != "I":
                        if fault:
                            now[fault] += 1
                        if now["role"] is not None and now["role"][:1] + was[:1] not in ("su", "ua", "au"):
                            now["illegal"] += 1
                        now["role"] = was
                        if turn is not None and turn != now["last"]:
                            now["first"], now["last"], now["turns"] = turn if now["turns"] == 0 else now["first"], turn, now["turns"] + 1
                    if edit != "D":
                        now["sha"].update((b"\n" if now["any"] else b"") + role.encode() + b":")
                        now["sha"].update(text)
                        now["any"] = True
        if now is not None:
            finished()
        if out:
            yield gone()

    return edits.mapInArrow(run, f"conv_id {kind.simpleString()}, {', '.join(f'{n} long' for n in numbers)}, audit string, repaired_sha256 string")


def repair_audit(conversations: DataFrame) -> DataFrame:
    """summaries of the damaged conversations, and a row of zeros for each conversation that lost all its rows."""
    found = summaries(repaired(damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("every")).distinct()
    rows = every.join(found, F.expr("every <=> conv_id"), "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("every").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
