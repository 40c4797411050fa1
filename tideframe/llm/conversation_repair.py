"""Conversation structure repair over an automaton that shares the ends of all conversations' signatures.

A conversation's *signature* has one symbol a row: the class of its role and its fault. The cheapest edits of a row depend
on nothing but the signature's rest and the state of the role grammar, so signatures are minimised from their ends: equal
ends are one automaton node, whatever the conversations. Sorted by reversed signature, neighbours share the nodes of their
longest common end; a stack holds those of the present signature, and only nodes that the one before did not have are made.
Each node holds, for each grammar state, the cost to go and the first piece of the cheapest edits of least spelling; the
pieces are prefix-free and lead to one state each, so the audit of a node is its piece and the audit of the next node.

Jobs: one shuffle of light rows (no texts) by conversation makes the signatures, which are stored; one range shuffle by
reversed signature and conversation gives costs and audits, so that a signature which many conversations have is split
over tasks; one shuffle of the texts by conversation applies the audits. Groups are streamed in sorted order: a task holds
one signature (a byte a row, as the audit it returns), never the rows of a conversation.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert an empty user or
assistant row 3; a truncated row that stays adds 3. What stays reads ``(s?(ua)+)?`` by role initials.

Defined results: null roles and texts are one space; rows of a null ``conv_id`` are one conversation; rows of one turn are
ordered by a digest of role and text, null turns first; initials count as they are written, and roles that begin with none
of s, u and a can't be kept; repeated rows are duplicates; a conversation without present rows has zeros, an empty audit
and no repaired rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.shared import prepare, stored

KEEP, REROLE, DELETE, INSERT, OPEN = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols: the class of a row's role (other: o), upper case if it is truncated; X must be deleted.
FORCED = "X"
SOLID = r"[^\x20\x09-\x0D]"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")

Choice = tuple[int, str, int]


def _emit(state: int, role: str) -> int | None:
    """The state after a row of this role class, or None where the grammar has no such row."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "a":
        return ASSISTANT if state == USER else None
    return USER if role == "u" and state != USER else None


def _options(state: int, symbol: str) -> Iterator[Choice]:
    """(cost, edits, state after) of every way to deal with one row: up to two insertions, then its own edit."""
    role, late = symbol.lower(), OPEN * symbol.isupper()
    for k in range(3):
        cost, done = INSERT * k, "I" * k
        yield cost + DELETE, done + "D", state
        if symbol != FORCED:
            if (kept := _emit(state, role)) is not None:
                yield cost + KEEP + late, done + "K", kept
            yield cost + REROLE + late, done + "R", ASSISTANT if state == USER else USER
        state = ASSISTANT if state == USER else USER


#: What closes a conversation in each state.
CLOSING = ("", "II", "I", "")


class Automaton:
    """Nodes of the present signature's ends, the last row's first. ``step`` is remembered by relative costs, of which few occur."""

    def __init__(self) -> None:
        self.signature = ""
        self.costs: list[tuple[int, tuple[int, ...]]] = [(0, tuple(INSERT * len(x) for x in CLOSING))]
        self.choices: list[tuple[tuple[str, int], ...]] = []
        self.steps: dict[tuple[tuple[int, ...], str], tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]] = {}
        self.made = 0

    def _step(self, ahead: tuple[int, ...], symbol: str):
        best = [min((cost + ahead[to], edits, to) for cost, edits, to in _options(q, symbol)) for q in range(4)]
        low = min(x[0] for x in best)
        return low, tuple(x[0] - low for x in best), tuple(x[1:] for x in best)

    def read(self, signature: str) -> None:
        """Make ``signature`` (from its end) the present one; nodes it shares with the one before stay."""
        shared = 0
        for a, b in zip(self.signature, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.costs[shared + 1 :], self.choices[shared:]
        for symbol in signature[shared:]:
            base, ahead = self.costs[-1]
            if (ahead, symbol) not in self.steps:
                self.steps[ahead, symbol] = self._step(ahead, symbol)
            more, relative, choices = self.steps[ahead, symbol]
            self.costs.append((base + more, relative))
            self.choices.append(choices)
            self.made += 1
        self.signature = signature

    def best(self, state: int = START) -> tuple[int, str]:
        """Cost and audit of the whole present signature."""
        base, relative = self.costs[-1]
        cost, out = base + relative[state], []
        for choices in reversed(self.choices):
            edits, state = choices[state]
            out.append(edits)
        return cost, "".join(out) + CLOSING[state]


def prepared(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The columns the operator uses. Rows that are not ``present`` only name their conversation."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    tie = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), tie.alias("tie"), (F.lit(True) if present is None else present).alias("present"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows damaged by the checksum of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 unpunctuates, 3 repeats, 4 makes user."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = (F.crc32(name.cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return prepared(rows, F.col("present"))


def _marked(rows: DataFrame) -> DataFrame:
    """Light rows in order within each conversation, each with its symbol and what it adds to the counts."""
    blank, closed = ~F.col("text").rlike(SOLID), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("conv_id", "turn", "tie", "present", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), closed.alias("closed"))
    light = light.repartition("conv_id")  # all windows below keep this partitioning
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "tie").orderBy(F.col("turn").asc_nulls_first())) > 1
    light = light.withColumn("seen", seen)
    order = Window.partitionBy("conv_id", "present").orderBy(F.col("turn").asc_nulls_first(), "tie")
    whole = Window.partitionBy("conv_id").orderBy("present", F.col("turn").asc_nulls_first(), "tie")
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    light = light.select("*", (F.row_number().over(whole) == 1).alias("begins"), pair.alias("pair"), F.lag("turn").over(order).alias("before"))
    kept = ~F.col("blank") & ~F.col("seen")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(~kept, FORCED).when(F.col("closed"), letter).otherwise(F.upper(letter))
    here = lambda c: (F.col("present") & F.coalesce(c, F.lit(False))).cast("int")
    light = light.sortWithinPartitions("conv_id", "present", F.col("turn").asc_nulls_first(), "tie")  # whatever window came last
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))
    return light.select(
        "conv_id", "begins", F.when(F.col("present"), F.ascii(symbol)).otherwise(0).alias("symbol"), F.when(F.col("present"), F.col("turn")).alias("turn"),
        here(new_turn).alias("new"), here(F.col("blank")).alias("blank"), here(~F.col("blank") & F.col("seen")).alias("duplicate"),
        here(kept & ~F.col("closed")).alias("truncated"), here(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
    )


def _signatures(schema: pa.Schema):
    """Rows of sorted conversations to one row each: its counts and its signature, from the end."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, sums, turns = None, bytearray(), np.zeros(5, np.int64), []

        def row() -> tuple:
            gaps = int(max(turns) - min(turns) + 1 - sums[0]) if turns else 0
            return (conv, gaps, *map(int, sums[1:]), held.decode()[::-1])

        begun = False
        for batch in batches:
            out: list[tuple] = []
            get = {name: batch.column(name) for name in batch.schema.names}
            symbols = get["symbol"].to_numpy(zero_copy_only=False).astype(np.uint8)
            turn = get["turn"].to_pylist()
            values = np.stack([get[c].to_numpy(zero_copy_only=False) for c in ("new", "blank", "duplicate", "truncated", "illegal")])
            first = np.flatnonzero(get["begins"].to_numpy(zero_copy_only=False))
            cuts = [0, *first.tolist(), batch.num_rows]
            for k in range(len(cuts) - 1):
                lo, hi = cuts[k], cuts[k + 1]
                if k:
                    if begun:
                        out.append(row())
                    conv, held, sums, turns, begun = get["conv_id"][lo].as_py(), bytearray(), np.zeros(5, np.int64), [], True
                if hi > lo:
                    part = symbols[lo:hi]
                    held += part[part > 0].tobytes()
                    sums = sums + values[:, lo:hi].sum(1)
                    there = [t for t in turn[lo:hi] if t is not None]
                    turns = [min(there + turns), max(there + turns)] if there else turns
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema, strict=True)], schema=schema)

    return job


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of rows sorted by reversed signature."""
    automaton, last, found = Automaton(), None, (0, "")
    for batch in batches:
        out = []
        for signature in batch.column("signature").to_pylist():
            if signature != last:
                automaton.read(signature)
                last, found = signature, automaton.best()
            out.append(found)
        table = pa.table(batch).drop_columns("signature")
        table = table.append_column("cost", pa.array([x[0] for x in out], pa.int64())).append_column("audit", pa.array([x[1] for x in out], pa.string()))
        yield from table.to_batches()


def repair_plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``prepared`` rows."""
    prepare(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    marked = _marked(rows)
    fields = [pa.field("conv_id", _arrow_type(marked)), *(pa.field(c, pa.int64()) for c in COUNTS), pa.field("signature", pa.string())]
    light = stored(marked.mapInArrow(_signatures(pa.schema(fields)), f"conv_id {kind}, {counts}, signature string"), "signatures")
    dealt = light.repartitionByRange(F.substring("signature", 1, 64), F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.mapInArrow(_costs, f"conv_id {kind}, {counts}, cost long, audit string")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def _applied(schema: pa.Schema, digests: bool):
    """Conversations, each its plan first and then its rows in order, to repaired rows or to one digest each."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict | None = None
        audit, at, state, n, sha = "", 0, START, 0, hashlib.sha256()
        out: list[tuple] = []

        def put(role: str, text: str, edit: str) -> None:
            nonlocal n
            if not digests:
                out.append((plan["conv_id"], None if edit == "D" else n, role, text, edit))
            elif edit != "D":
                sha.update(f"{chr(10) * (n > 0)}{role}:{text}".encode())
            n += edit != "D"

        def inserted() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                put("assistant" if state == USER else "user", "", "I")
                state, at = ASSISTANT if state == USER else USER, at + 1

        def closed() -> None:
            if plan is not None:
                inserted()
                if digests:
                    out.append((*(plan[c] for c in ("conv_id", *COUNTS, "cost", "audit")), sha.hexdigest()))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            plans, roles, texts = batch.column("plan").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for k, new in enumerate(plans):
                if new is not None:
                    closed()
                    plan = new | {"conv_id": batch.column("conv_id")[k].as_py()}
                    audit, at, state, n, sha = new["audit"], 0, START, 0, hashlib.sha256()
                    continue
                inserted()
                role, edit = roles[k], audit[at]
                at += 1
                if edit == "R":
                    role = "assistant" if state == USER else "user"
                put(role, texts[k], edit)
                if edit != "D":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            if out:
                yield flushed()
        closed()
        if out:
            yield flushed()

    return job


def repair(rows: DataFrame, digests: bool = False) -> DataFrame:
    """The edited rows (conv_id, at, role, text, edit) of ``prepared`` conversations, deleted ones with a null ``at``.

    With ``digests`` one row a conversation: its counts, cost, audit and the SHA-256 of its repaired ``role:text`` lines. A
    digest is one sequential reading, so a conversation's texts pass through one task, which holds one batch of them.
    """
    plans = repair_plans(rows)
    kind = plans.schema["conv_id"].dataType.simpleString()
    packed = F.struct(*COUNTS, "cost", "audit").alias("plan")
    nothing = {"turn": "long", "tie": "string", "role": "string", "text": "string"}
    first = plans.select("conv_id", packed, *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    texts = rows.where("present").select("conv_id", F.lit(None).cast(first.schema["plan"].dataType).alias("plan"), *nothing)
    both = first.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("plan").isNull(), F.col("turn").asc_nulls_first(), "tie")
    both = both.select("conv_id", "plan", "role", "text")
    conv = pa.field("conv_id", _arrow_type(plans))
    if digests:
        fields = [conv, *(pa.field(c, pa.int64()) for c in (*COUNTS, "cost")), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
        shape = f"conv_id {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string, repaired_sha256 string"
    else:
        fields = [conv, pa.field("at", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string()), pa.field("edit", pa.string())]
        shape = f"conv_id {kind}, at long, role string, text string, edit string"
    return both.mapInArrow(_applied(pa.schema(fields), digests), shape)
