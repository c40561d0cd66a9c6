"""Conversations brought back to the order system? (user assistant)+ by the cheapest edits.

Each row is kept, given the other role (user or assistant), or deleted, and empty messages may be put in anywhere. What is left to
pay is a vector of four costs, one for each state: nothing yet, after the system message, after a user, after an assistant. Less
its smallest cost, a vector is one of few, whatever comes behind it. Tables in the manner of the Four Russians hold, for each such
vector behind a block of BLOCK rows and each sequence of row kinds in the block, the vector before it and what was taken off; so a
conversation is read backward a block at a time. To trace the edits, each block is then expanded backward from the vector kept
at its end, and of equally cheap edits the one with the least letter (Delete, Insert, Keep, Rerole) is taken first.

Rows of a conversation come in the order of turn (nulls first), then role, md5 of the text, and copy; rows equal in all of these are
the same. A null role or text is one space; rows of a null conv_id are one conversation; a role that isn't a word of the grammar
can be given another or deleted, and one of no characters leaves the order as it is. An empty table gives no rows; further
columns are not read.

Two shuffles by conversation: one of the rows' kinds, a byte each for the tables, and one of the texts beside the edits. Both are
sorted by Spark, which spills, and read as a stream: a task holds the kinds and edits of one conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.llm.common import resident, small_batches

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Kinds of a row's role, by initial; and the states: nothing yet, after system, after user, after assistant.
SYSTEM, USER, ASSISTANT, OTHER, NONE = range(5)
START, SYSTEMED, USERED, ANSWERED = range(4)
NAMES = {USERED: "user", ANSWERED: "assistant"}
NEXT = (USERED, USERED, ANSWERED, USERED)
KINDS, BLOCK = 11, 4
FAULTS = ("blank", "duplicate", "truncated")


def kept_state(state: int, kind: int) -> int | None:
    """The state after a row that stays as it is, if it may."""
    if kind == NONE:
        return state
    wanted = {SYSTEM: SYSTEMED if state == START else None, USER: NEXT[state] if NEXT[state] == USERED else None, ASSISTANT: NEXT[state] if NEXT[state] == ANSWERED else None}
    return wanted.get(kind)


def choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of what can be done with a row; symbol is 0 for rows that must go, else 1 + 2 * kind + truncated."""
    yield "D", DELETE, state
    if symbol:
        kind, cut = (symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED
        stays = kept_state(state, kind)
        if stays is not None:
            yield "K", KEEP + cut, stays
        yield "R", REROLE + cut, NEXT[state]


class Tables:
    """Normalised vectors, and the steps over one row and over a block of rows."""

    def __init__(self) -> None:
        end = (0, 2 * INSERT, INSERT, 0)
        self.vectors, numbers = [end], {end: 0}
        one: list[list[tuple[int, int]]] = []
        self.moves: list[list[list[tuple[str, int]]]] = []  # by vector behind, symbol, state: the edits up to this row's, and the state after
        for vector in self.vectors:  # grows meanwhile
            steps, moves = [], []
            for symbol in range(KINDS):
                costs = [min(cost + vector[after] for _, cost, after in choices(symbol, q)) for q in range(4)]
                paid = [min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4)]
                least = min(paid)
                before = tuple(c - least for c in paid)
                if before not in numbers:
                    numbers[before] = len(self.vectors)
                    self.vectors.append(before)
                steps.append((numbers[before], least))
                moves.append([self.edits(symbol, q, vector, paid) for q in range(4)])
            one.append(steps)
            self.moves.append(moves)
        step = np.array(one, np.int64)
        into, off = step[:, :, 0], step[:, :, 1]
        self.into, self.off = into.tolist(), off.tolist()
        far, taken = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(BLOCK):  # one more row in front: the number of a block is its first row's symbol + KINDS * the number of the rest
            taken = (taken[:, :, None] + off[far]).reshape(len(far), -1)
            far = into[far].reshape(len(far), -1)
        self.block_into, self.block_off = far, taken

    @staticmethod
    def edits(symbol: int, state: int, vector: tuple, paid: list[int]) -> tuple[str, int]:
        out = ""
        while True:
            options = {letter: after for letter, cost, after in choices(symbol, state) if cost + vector[after] == paid[state]}
            inserted = INSERT + paid[NEXT[state]] == paid[state]
            if "D" in options:
                return out + "D", options["D"]
            if inserted:
                out, state = out + "I", NEXT[state]
                continue
            letter = "K" if "K" in options else "R"
            return out + letter, options[letter]


def cheapest(symbols: np.ndarray) -> tuple[int, str]:
    """(cost, edits) of a conversation of these row symbols."""
    tables: Tables = resident(Tables)
    n = len(symbols)
    short = n % BLOCK  # rows in front of the first whole block
    numbers = (symbols[short:].reshape(-1, BLOCK).astype(np.int64) * (KINDS ** np.arange(BLOCK))).sum(axis=1)
    cost, vector = 0, 0
    behind = [0] * (len(numbers) + 1)
    for k in range(len(numbers) - 1, -1, -1):
        behind[k + 1] = vector
        cost += int(tables.block_off[vector, numbers[k]])
        vector = int(tables.block_into[vector, numbers[k]])
    behind[0] = vector
    state, out = START, []
    first, start = True, 0
    while start < n:
        size = short if first and short else BLOCK
        block = symbols[start : start + size].tolist()
        k = (start + size - short) // BLOCK
        inside = [behind[k]]
        for symbol in reversed(block):
            if first and short:
                cost += tables.off[inside[-1]][symbol]
            inside.append(tables.into[inside[-1]][symbol])
        for j, symbol in enumerate(block):
            edit, state = tables.moves[inside[size - 1 - j]][symbol][state]
            out.append(edit)
        if first:
            vector, first = inside[-1], False
        start += size
    cost += tables.vectors[vector][START]
    while state in (SYSTEMED, USERED):
        out.append("I")
        state = NEXT[state]
    return cost, "".join(out)


def with_facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls, copy, there, mark (md5 of the text). Rows that aren't there only name their conversation."""
    small_batches(rows.sparkSession)
    extra = {c: F.col(c) if c in rows.columns else F.lit(d) for c, d in (("copy", 0), ("there", True))}
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), *(x.alias(c) for c, x in extra.items()))
    return out.withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))


ORDER = ("turn", "role", "mark", "copy")


def in_order(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Rows shuffled by conversation and sorted in it."""
    order = [F.asc_nulls_first(c) for c in ORDER]
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *keys, *order)


def kind_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).when(first == "", NONE).otherwise(OTHER)


def fault_of() -> Column:
    """0 none, 1 blank, 2 duplicate, 3 truncated: the first that applies."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    return F.when(text == "", 1).when(F.substring(text, -1, 1).isin(".", "!", "?"), 0).otherwise(3)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit. rows: conv_id, turn, role, text, and if wanted
    copy and there (see with_facts)."""
    facts = with_facts(rows).select("conv_id", *ORDER, "there", kind_of(F.col("role")).cast("int").alias("kind"), fault_of().cast("int").alias("fault")).repartition("conv_id")
    again = F.row_number().over(W.partitionBy("conv_id", "there", "role", "mark").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    facts = facts.withColumn("fault", F.when((F.col("fault") != 1) & again, 2).otherwise(F.col("fault")))
    facts = facts.sortWithinPartitions(F.asc_nulls_first("conv_id"), *(F.asc_nulls_first(c) for c in ORDER)).select("conv_id", "turn", "there", "kind", "fault")
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit"]
        types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string()]
        book = None
        for batch in batches:
            done = []
            for conv, a, b in stretches(batch.column("conv_id")):
                if book is None or book.conv != conv:
                    if book is not None:
                        done.append(book.close())
                    book = Book(conv)
                book.add(batch.slice(a, b - a))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if book is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(book.close(), types, strict=True)], names)

    return facts.mapInArrow(run, f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def stretches(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, start, end) of equal neighbours."""
    if not len(column):
        return
    coded = column.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield column[a].as_py(), a, b


class Book:
    """What is known of one conversation while its rows pass by in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.symbols, self.kinds = conv, bytearray(), bytearray()
        self.faults = np.zeros(4, np.int64)
        self.first = self.last = None
        self.turns = 0

    def add(self, batch: pa.RecordBatch) -> None:
        there = batch.column("there").to_numpy(zero_copy_only=False)
        kind, fault = (batch.column(c).to_numpy(zero_copy_only=False)[there] for c in ("kind", "fault"))
        self.symbols += np.where((fault == 1) | (fault == 2), 0, 1 + 2 * kind + (fault == 3)).astype(np.uint8).tobytes()
        self.kinds += kind.astype(np.uint8).tobytes()
        self.faults += np.bincount(fault, minlength=4)
        turns = [t for t, x in zip(batch.column("turn").to_pylist(), there.tolist(), strict=True) if x and t is not None]
        if turns:
            self.turns += len(set(turns)) - (turns[0] == self.last)
            self.first = turns[0] if self.first is None else self.first
            self.last = turns[-1]

    def close(self) -> tuple:
        kinds = np.frombuffer(bytes(self.kinds), np.uint8).astype(np.int64)
        pairs = kinds[:-1] * 5 + kinds[1:]
        legal = np.isin(pairs, [SYSTEM * 5 + USER, USER * 5 + ASSISTANT, ASSISTANT * 5 + USER])
        cost, audit = cheapest(np.frombuffer(bytes(self.symbols), np.uint8))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:].tolist(), int((~legal).sum()), cost, audit


class Messages:
    """The messages of one conversation, as its rows pass by in order and its edits are carried out."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", NAMES[self.state], ""

    def of(self, role: str, text: str, kind: int) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            yield edit, NAMES[self.state], text
        elif edit == "K":
            self.state = kept_state(self.state, kind)
            yield edit, role, text


REPORT = ("gaps", *FAULTS, "illegal", "cost", "audit")


def beside_edits(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows of each conversation in order, its report in a row before them."""
    rows = with_facts(rows).where("there")
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.select(*ORDER, "text").dtypes] + [F.lit(None).cast("int").alias("kind")]
    report = F.struct(*REPORT)
    texts = rows.select("conv_id", F.lit(1).alias("part"), *ORDER, "text", kind_of(F.col("role")).cast("int").alias("kind"), F.lit(None).cast(reports.select(report.alias("r")).schema["r"].dataType).alias("report"))
    return in_order(reports.select("conv_id", F.lit(0).alias("part"), *none, report.alias("report")).unionByName(texts), "part").select("conv_id", "role", "text", "kind", "report")


def each_message(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object]]:
    """(0, (conv_id, report)), then (1, message) for its messages, then (2, None), for one conversation after the other."""
    messages = None
    for batch in batches:
        conv = batch.column("conv_id").to_pylist()
        columns = (batch.column(c).to_pylist() for c in ("role", "text", "kind", "report"))
        for key, role, text, kind, report in zip(conv, *columns, strict=True):
            if report is not None:
                if messages is not None:
                    yield from ((1, m) for m in messages.inserted())
                    yield 2, None
                messages = Messages(report["audit"])
                yield 0, (key, report)
            else:
                yield from ((1, m) for m in messages.of(role, text, kind))
    if messages is not None:
        yield from ((1, m) for m in messages.inserted())
        yield 2, None


def repaired_messages(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of the repaired conversations; reports from audits(rows), written by then
    or worked out again."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types, names = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "place", "edit", "role", "text"]
        out, size, conv, place = [], 0, None, 0
        for what, item in each_message(batches):
            if what == 0:
                conv, place = item[0], 0
            elif what == 1:
                out.append((conv, place, *item))
                place, size = place + 1, size + len(item[2]) + 64
                if size > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return beside_edits(rows, reports).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")


def repair_reports(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports with repaired_sha256, the hash of the repaired conversation's role:text, one to a line; texts are hashed as they
    pass by."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types, names = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()], ["conv_id", *REPORT, "repaired_sha256"]
        out, size, row, digest, first = [], 0, None, None, True
        for what, item in each_message(batches):
            if what == 0:
                row, digest, first = (item[0], *(item[1][c] for c in REPORT)), hashlib.sha256(), True
            elif what == 1:
                digest.update(f"{'' if first else chr(10)}{item[1]}:{item[2]}".encode())
                first = False
            else:
                out.append((*row, digest.hexdigest()))
                size += len(row[-1]) + 128
                if size > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return beside_edits(rows, reports).mapInArrow(run, f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
