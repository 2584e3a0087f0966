"""Repair of conversations' structure by error-correcting Earley parsing.

A weighted grammar of roles says what a conversation is: nothing, or a system row and pairs of a user's and an assistant's
row. Beside its own productions it has those of errors: a row may be deleted, take the role that is wanted, or be put in.
A conversation's rows are parsed from left to right; each column of the chart holds items (production, place in it, column
where it began), and an item keeps the least (cost, audit), audit being the initials of the edits so far. The completed
chart's start item tells the repair.

A column follows from the one before it alone. Items that cost ``LOST`` more than the cheapest can't win and go; what the
audits of all others begin with is decided, so it is put out and its rows are let go. A conversation is thus streamed in the
order of its turns, whatever its length, in one task, as its digest needs; equal rows of a turn are counted before that, and whether a row's
role and text came earlier is found by role and text, so that nothing of a conversation is gathered.

``damage`` makes conversations with known kinds of faults. ``repair`` gives a row for each edit; ``conversation_digests``
reads those back, in order.

Defined results: a null role or text is one space, as is a null id or turn in the key of ``damage``; rows with a null
conversation form one conversation of null id; null turns come first; rows of one turn are ordered by role and text; an
empty role fits nothing, so its row can't be kept; a conversation whose rows were all dropped has no edits and one row
of nulls; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import reachable

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
CUT = 3  # a truncated row that stays
#: From any item one can go on as from any other at this cost more: put in one row, delete a system row.
LOST = COST[INSERT] + COST[DELETE]
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
ROLES = ("user", "assistant")  # that are given, by turns
HELD = 32  # rows after which it is asked what is decided
MOST_BYTES = 8 << 20  # of a batch of edits
NAMES = ["conv_id", "turn", "edit", "cost", "fault", "given", "role", "text"]
DIGESTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

#: What a conversation is. Only the first symbol of a production is one that has productions of its own, so all items begin in the first column.
GRAMMAR = {"Start": [(), ("Talk",)], "Lead": [(), ("System",), ("Talk",)], "Talk": [("Lead", "User", "Assistant")]}
RULES = [(head, body) for head, bodies in GRAMMAR.items() for body in bodies]
#: What fills a slot: the initial of a role that is kept, or the role that is given by the productions of errors.
SLOTS = {"System": ("s", None), "User": ("u", "user"), "Assistant": ("a", "assistant")}

Best = tuple[int, str]
Item = tuple[int, int]  # production, and how much of it is there


@dataclass
class Row:
    role: str
    text: str
    turn: object = None
    copies: int = 1
    seen: bool = False  # role and text came earlier
    fault: str | None = None

    def __post_init__(self) -> None:
        said = self.text.strip(" \t\n\x0b\x0c\r")
        self.fault = BLANK if not said else DUPLICATE if self.seen else TRUNCATED if said[-1] not in ".!?" else None


def closed(column: dict[Item, Best]) -> dict[Item, Best]:
    """Predict, complete and put in rows until no item gets better."""
    todo = list(column)

    def offer(item: Item, value: Best) -> None:
        if item not in column or value < column[item]:
            column[item] = value
            todo.append(item)

    while todo:
        rule, place = todo.pop()
        cost, audit = column[rule, place]
        head, body = RULES[rule]
        if place == len(body):
            for k, (_, other) in enumerate(RULES):  # those that wait for this head in the first column, where they cost nothing
                if other[:1] == (head,):
                    offer((k, 1), (cost, audit))
        elif body[place] in GRAMMAR:
            for k, (other, _) in enumerate(RULES):
                if other == body[place]:
                    offer((k, 0), (0, ""))
        elif SLOTS[body[place]][1]:
            offer((rule, place + 1), (cost + COST[INSERT], audit + INSERT))
    return column


def first_column() -> dict[Item, Best]:
    return closed({(k, 0): (0, "") for k, (head, _) in enumerate(RULES) if head == "Start"})


def scanned(column: dict[Item, Best], row: Row) -> dict[Item, Best]:
    """The next column: slots take the row, or the row goes and they stay; so do complete conversations."""
    out: dict[Item, Best] = {}
    stays = row.fault not in (BLANK, DUPLICATE)
    more = CUT if row.fault == TRUNCATED else 0
    for (rule, place), (cost, audit) in column.items():
        head, body = RULES[rule]
        slot = SLOTS.get(body[place]) if place < len(body) else None
        if slot or head == "Start" and place == len(body):
            found = [((rule, place), (cost + COST[DELETE], audit + DELETE))]
            if slot and stays and row.role[:1] == slot[0]:
                found.append(((rule, place + 1), (cost + COST[KEEP] + more, audit + KEEP)))
            if slot and stays and slot[1]:
                found.append(((rule, place + 1), (cost + COST[REROLE] + more, audit + REROLE)))
            for item, value in found:
                if item not in out or value < out[item]:
                    out[item] = value
    if row.copies > 1:  # equal rows right after go; rows are put in after these, as D comes before I
        out = {item: (cost + (row.copies - 1) * COST[DELETE], audit + DELETE * (row.copies - 1)) for item, (cost, audit) in out.items()}
    out = closed(out)
    least = min(cost for cost, _ in out.values())
    return {item: value for item, value in out.items() if value[0] <= least + LOST}


@dataclass
class Edit:
    edit: str
    cost: int
    row: Row | None  # None: put in
    fault: str | None
    role: str | None  # None: deleted


class Parse:
    """One conversation. Rows are held from the first edit that isn't decided."""

    def __init__(self) -> None:
        self.column = first_column()
        self.rows: deque[Row] = deque()
        self.undone = 0  # copies of the first held row that are done
        self.pairs = 0  # rows of users and assistants that were put out

    def take(self, row: Row) -> list[Edit]:
        self.column = scanned(self.column, row)
        self.rows.append(row)
        return self.decided() if len(self.rows) >= HELD else []

    def decided(self) -> list[Edit]:
        """What all items begin with, and never change."""
        common = os.path.commonprefix([audit for _, audit in self.column.values()])
        self.column = {item: (cost, audit[len(common) :]) for item, (cost, audit) in self.column.items()}
        return self.replayed(common)

    def end(self) -> list[Edit]:
        best = min(value for (rule, place), value in self.column.items() if RULES[rule][0] == "Start" and place == len(RULES[rule][1]))
        return self.replayed(best[1])

    def replayed(self, audit: str) -> list[Edit]:
        """The edits of an audit; the roles that are given follow from what was put out before."""
        out = []
        for edit in audit:
            if edit == INSERT:
                out.append(Edit(edit, COST[INSERT], None, None, ROLES[self.pairs % 2]))
                self.pairs += 1
                continue
            row = self.rows[0]
            fault = DUPLICATE if self.undone and row.fault != BLANK else row.fault
            self.undone += 1
            if self.undone == row.copies:
                self.rows.popleft()
                self.undone = 0
            if edit == DELETE:
                out.append(Edit(edit, COST[DELETE], row, fault, None))
                continue
            role = row.role if edit == KEEP else ROLES[self.pairs % 2]
            self.pairs += role[:1] != SLOTS["System"][0]
            out.append(Edit(edit, COST[edit] + (CUT if fault == TRUNCATED else 0), row, fault, role))
        return out


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: how many times the row is there; 0 for rows that were dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def prepared(df: DataFrame) -> DataFrame:
    """Each conversation's different rows in one partition, in order, with their copies and whether role and text came earlier.

    What was dropped leaves one row of no copies for each conversation."""
    there = F.col("copies") > 0
    copies = F.col("copies") if "copies" in df.columns else F.lit(1)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))
    rows = rows.select("conv_id", *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    return once.withColumn("seen", seen).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(df: DataFrame) -> DataFrame:
    """A row for each edit, in order: conv_id, turn, edit, cost, fault, given (the role that was there), role, text (null where the row goes).

    df: conv_id, turn, role, text and, if given, copies. Rows of one conversation stay in one partition, in the order of the edits.
    """
    kinds = df.schema["conv_id"].dataType, df.schema["turn"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        parse, any_row, size = Parse(), False, 0
        out: list[tuple] = []

        def tell(edits: list[Edit]) -> None:
            nonlocal size
            for e in edits:
                text = None if e.role is None else e.row.text if e.row else ""
                out.append((now, e.row.turn if e.row else None, e.edit, e.cost, e.fault, e.row.role if e.row else None, e.role, text))
                size += len(text or "") + 64

        def ended() -> None:
            tell(parse.end() if any_row else [])
            if not any_row:
                out.append((now, *[None] * 7))

        def batch_of(schema: pa.Schema) -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out, strict=True)) or [[]] * 8
            out.clear()
            size = 0
            types = [schema.field(0).type, schema.field(1).type, pa.string(), pa.int64(), *[pa.string()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], NAMES)

        schema = None
        for batch in batches:
            schema = batch.schema
            for k in range(batch.num_rows):
                conv, turn, role, text, copies, seen = (c[k].as_py() for c in batch.columns)
                if now is run or conv != now:
                    if now is not run:
                        ended()
                    now, parse, any_row = conv, Parse(), False
                if copies:
                    any_row = True
                    tell(parse.take(Row(role, text, turn, copies, seen)))
                if size >= MOST_BYTES:
                    yield batch_of(schema)
        if now is not run:
            ended()
            yield batch_of(schema)

    out = T.StructType([T.StructField("conv_id", kinds[0]), T.StructField("turn", kinds[1]), T.StructField("edit", T.StringType()), T.StructField("cost", T.LongType()), *(T.StructField(c, T.StringType()) for c in NAMES[4:])])
    reachable(df.sparkSession)
    return prepared(df).mapInArrow(run, out)


class Digest:
    def __init__(self) -> None:
        self.turns = self.illegal = self.cost = 0
        self.low = self.high = self.given = None
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def take(self, turn: object, edit: str | None, cost: int, fault: str | None, given: str | None, role: str | None, text: str | None) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += cost
        if fault:
            self.faults[fault] += 1
        if edit != INSERT:
            if turn is not None and turn != self.high:
                self.turns += 1
                self.low, self.high = turn if self.low is None else self.low, turn
            if self.given is not None and self.given[:1] + given[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.given = given
        if role is not None:
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def conversation_digests(edits: DataFrame) -> DataFrame:
    """One row a conversation, read back from the edits of ``repair``, in whose order rows still are. Of a conversation, it holds the audit alone."""
    kind = edits.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        digest = Digest()

        def batch_of(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], DIGESTS)

        of = None
        for batch in batches:
            of, rows = batch.schema.field(0).type, []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is run or conv != now:
                    if now is not run:
                        rows.append((now, *digest.row()))
                    now, digest = conv, Digest()
                digest.take(*rest)
            if rows:
                yield batch_of(rows, of)
        if now is not run:
            yield batch_of([(now, *digest.row())], of)

    out = T.StructType([T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in DIGESTS[1:7]), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return edits.mapInArrow(run, out)
