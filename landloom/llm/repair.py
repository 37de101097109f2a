"""Conversation structure repair by weighted CYK interval parsing.

The wanted role initials are s?(ua)+ or nothing. A row can be kept, given another role or deleted, and rows can be put in;
each edit has a cost. The grammar is in Chomsky normal form. Its nonterminals name every piece that a wanted conversation
can be cut into (nothing, u..a, u..u, a..a, a..u, s, s..a, s..u), so an interval of rows has a cell for each: the least
(cost, audit), where the audit holds the edits' initials. Leaves are single rows, closed under putting rows in at either
side. Inside an interval of BLOCK rows all spans are filled bottom-up by length over all splits; as the pieces are closed
under cutting, intervals are then joined two by two, each step doubling the span. Two audits of one cost and one interval
are never prefixes of each other (an added I costs more), so the least of a whole is made of the least of its parts.

Rows are sorted by conversation and turn over all partitions; a task parses what it reads as a stream. Conversations that
may go on in another partition, or are longer than HELD bytes, leave one cell for each partition; these are joined after
it, so a conversation of any length is parsed by many tasks. Only its repaired text is then read in order by one task, as
a stream, since a digest over it is sequential.

Defined cases: null conv_id, role and text count as one space, a null turn comes first; rows of one turn follow in order of
role and digest; equal rows are one row with a count; a conversation without rows has zeros and an empty audit; an empty
table gives an empty table; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of an interval whose spans are all filled; bytes of a conversation's rows that a task holds; cells of intervals kept.
BLOCK, HELD, KEPT = 12, 8 << 20, 100_000
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FULL = re.compile(r"[^\x20\x09-\x0D]")

Cell = list  # of (cost, audit) or None by nonterminal
PIECES = ["", "ua", "uu", "aa", "au", "s", "sa", "su"]  # first and last initial of what a nonterminal gives


def _rules() -> list[tuple[int, int, int]]:
    """left, right, result of each binary rule."""
    out = []
    for i, x in enumerate(PIECES):
        for j, y in enumerate(PIECES):
            if not x or not y:
                out.append((i, j, i or j))
            elif y[0] != "s" and (x == "s" and y[0] == "u" or x != "s" and x[-1] != y[0]):
                out.append((i, j, PIECES.index(x[0] + y[-1])))
    return out


RULES = _rules()
WHOLE = [PIECES.index(x) for x in ("", "ua", "sa")]
PUT_IN: Cell = [(INSERT, "I") if x in ("uu", "aa") else None for x in PIECES]


def joined(x: Cell, y: Cell, out: Cell | None = None) -> Cell:
    """The cell of an interval from those of its two parts; of out too, if given."""
    out = [None] * len(PIECES) if out is None else out
    for i, j, k in RULES:
        if (a := x[i]) and (b := y[j]):
            cost, had = a[0] + b[0], out[k]
            if had is None or cost < had[0] or cost == had[0] and a[1] + b[1] < had[1]:
                out[k] = (cost, a[1] + b[1])
    return out


def closed(cell: Cell) -> Cell:
    """The cell with rows put in at either side, as long as that lowers an entry."""
    while (more := joined(PUT_IN, cell, joined(cell, PUT_IN, list(cell)))) != cell:
        cell = more
    return cell


def leaf(kind: str, copies: int = 1) -> Cell:
    """The cell of one row; kind: its role's initial (or *), then - (sound), t (truncated) or x (has to go, copies times)."""
    cell: Cell = [None] * len(PIECES)
    cell[0] = (DELETE * copies, "D" * copies)
    if kind[1] != "x":
        more = TRUNCATED * (kind[1] == "t")
        for who in "ua":
            cell[PIECES.index(2 * who)] = (KEEP + more, "K") if kind[0] == who else (REROLE + more, "R")
        if kind[0] == "s":
            cell[PIECES.index("s")] = (KEEP + more, "K")
    return closed(cell)


def chart(leaves: list[Cell]) -> Cell:
    """The cell of an interval: all its spans, by length, over all splits."""
    n = len(leaves)
    spans = {(i, i + 1): x for i, x in enumerate(leaves)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            out: Cell = [None] * len(PIECES)
            for k in range(i + 1, i + size):
                joined(spans[i, k], spans[k, i + size], out)
            spans[i, i + size] = out
    return spans[0, n]


class Intervals:
    """Rows in, one cell out: intervals of BLOCK rows, joined with those of the same length."""

    kept: dict = {}

    def __init__(self):
        self.kinds: list[str] = []
        self.done: list[tuple[int, Cell]] = []

    def row(self, kind: str) -> None:
        self.kinds.append(kind)
        if len(self.kinds) == BLOCK:
            self._close()

    def cell(self, cell: Cell, size: int = 1) -> None:
        self._close()
        self.done.append((size, cell))
        while len(self.done) > 1 and self.done[-2][0] <= self.done[-1][0]:
            (m, x), (n, y) = self.done[-2:]
            self.done[-2:] = [(m + n, joined(x, y))]

    def _close(self) -> None:
        if not self.kinds:
            return
        key, self.kinds = "".join(self.kinds), []
        found = self.kept.get(key)
        if found is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = self.kept[key] = chart([leaf(key[i : i + 2]) for i in range(0, len(key), 2)])
        self.cell(found)

    def whole(self) -> Cell | None:
        self._close()
        while len(self.done) > 1:
            (m, x), (n, y) = self.done[-2:]
            self.done[-2:] = [(m + n, joined(x, y))]
        return self.done[0][1] if self.done else None


def cheapest(cell: Cell | None) -> tuple[int, str]:
    return min(x for i in WHOLE if (x := cell[i])) if cell else (0, "")


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]


class Summary(Intervals):
    """What the rows of one conversation, or of its part in one partition, come to."""

    def __init__(self):
        super().__init__()
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        who = role[:1]
        if self.last is not None and self.last + who not in LEGAL:
            self.count["illegal"] += 1
        self.count["illegal"] += copies - 1  # copies of a row stand side by side
        self.first, self.last = who if self.first is None else self.first, who
        if turn is not None:
            self.count["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        blank = not FULL.search(text)
        if blank:
            self.count["blank"] += copies
        else:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            self.count["duplicate"] += copies if seen else copies - 1
            cut = not seen and end not in (".", "!", "?")
            self.count["truncated"] += cut
            if not seen:
                self.row((who if who in ("s", "u", "a") else "*") + ("t" if cut else "-"))
                copies -= 1
        if copies == 1:
            self.row("*x")
        elif copies:
            self.cell(leaf("*x", copies))

    def merge(self, other: dict) -> None:
        """The part that follows this one."""
        if other["first"] is None:
            return
        if self.last is not None and self.last + other["first"] not in LEGAL:
            self.count["illegal"] += 1
        for k in COUNTS:
            self.count[k] += other[k]
        if other["low"] is not None:
            self.count["turns"] -= other["low"] == self.high
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]
        self.first, self.last = other["first"] if self.first is None else self.first, other["last"]
        self.cell([(c, a) if c is not None else None for c, a in zip(other["costs"], other["audits"], strict=True)])

    def result(self) -> dict:
        cost, audit = cheapest(self.whole())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.count["turns"]
        return {"gaps": gaps, **{k: self.count[k] for k in COUNTS[:-1]}, "cost": cost, "audit": audit}

    def part(self) -> dict:
        cell = self.whole() or [None] * len(PIECES)
        return {**self.count, "low": self.low, "high": self.high, "first": self.first, "last": self.last, "costs": [x and x[0] for x in cell], "audits": [x and x[1] for x in cell]}


class Repaired:
    """The repaired rows, as the audit is followed."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, "a"

    def _put_in(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.last = "u" if self.last != "u" else "a"
            yield NAMES[self.last], ""

    def rows(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            yield from self._put_in()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.last = role[0]
                yield role, text
            elif edit == "R":
                self.last = "u" if self.last != "u" else "a"
                yield NAMES[self.last], text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._put_in()


class Digest:
    """SHA-256 over role:text lines."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1


# as Spark jobs

ROW = ["conv_id", "turn", "role", "text", "copies", "seen"]
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
PART = "part bigint, turns bigint, low bigint, high bigint, first string, last string, costs array<bigint>, audits array<string>"
OUT = f"conv_id bigint, {RESULT}, sha256 string, {PART}"
COLUMNS = [x.split(" ")[0] for x in OUT.split(", ")]
ARROW = pa.schema([(x, pa.list_(pa.int64()) if x == "costs" else pa.list_(pa.string()) if x == "audits" else pa.string() if x in ("audit", "sha256", "first", "last") else pa.int64()) for x in COLUMNS])


def _records(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple]:
    for b in batches:
        for first in range(0, len(b), rows):
            yield from zip(*(c.to_pylist() for c in b.slice(first, rows).columns), strict=True)


def sorted_rows(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies, seen, digest of each distinct row. copies: how often a row counts, 0 for not at all."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"))
    gone = F.col("copies") == 0
    rows = rows.select("conv_id", "turn", F.when(~gone, F.col("role")).alias("role"), F.when(~gone, F.col("text")).alias("text"), "copies")
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = same.withColumn("digest", F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32)))
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    stored = materialise(same, "repair-rows")
    firsts = stored.where("copies > 0").groupBy("conv_id", "digest").agg(F.min(order).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "earliest")
    marked = stored.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    return marked.select(*ROW[:-1], F.coalesce(order > F.col("earliest"), F.lit(False)).alias("seen"), "digest")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict.fromkeys(COLUMNS) | r for r in rows], schema=ARROW)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations as results; those at the partition's ends and the long ones as parts."""
    from pyspark import TaskContext

    part, out, first = TaskContext.get().partitionId(), [], True
    conv, now, held, size = None, None, [], 0

    def ended(at_end: bool) -> dict:
        if at_end or held is None:
            return {"conv_id": conv, "part": part, **now.part()}
        got = now.result()
        script, digest = Repaired(got["audit"]), Digest()
        for role, text, copies in held:
            digest.add(script.rows(role, text, copies))
        digest.add(script.rest())
        return {"conv_id": conv, **got, "sha256": digest.sha.hexdigest()}

    for conv_id, turn, role, text, copies, seen in _records(batches):
        if now is None or conv_id != conv:
            if now is not None:
                out.append(ended(first))
                first = False
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            conv, now, held, size = conv_id, Summary(), [], 0
        if copies:
            now.add(turn, role, text, copies, seen)
            if held is not None:
                held.append((role, text, copies))
                size += len(text) + 100
                if size > HELD:
                    held = None
    if now is not None:
        out.append(ended(True))
    yield _batch(out)


def _joined_parts(parts: pd.DataFrame) -> pd.DataFrame:
    """A conversation's parts, one for each partition that it reaches into, as one result."""
    whole = Summary()
    none = lambda x: None if x is None or x is pd.NA or x != x else x
    for r in parts.sort_values("part").to_dict("records"):
        r |= {k: none(r[k]) for k in ("low", "high", "first", "last")} | {"costs": [none(c) for c in r["costs"]], "audits": list(r["audits"])}
        whole.merge({k: int(v) if k in (*COUNTS, "low", "high") and v is not None else [c if c is None else int(c) for c in v] if k == "costs" else v for k, v in r.items()})
    return pd.DataFrame([{"conv_id": parts["conv_id"].iloc[0], **whole.result()}]).astype({"conv_id": "Int64"})


def _followed(turns: bool):
    """Rows after their conversation's audit -> its digest, or its repaired turns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "at", "role", "text"] if turns else ["conv_id", "sha256"]
        kind = pa.schema([(n, pa.int64() if n in ("conv_id", "at") else pa.string()) for n in names])
        out, size, script, digest, conv = [], 0, None, None, None

        def put(rows: Iterator[tuple[str, str]]) -> None:
            nonlocal size
            if not turns:
                return digest.add(rows)
            for role, text in rows:
                out.append((conv, digest.lines, role, text))
                digest.lines += 1
                size += len(text) + 100
            return None

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if size > HELD or len(out) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kind)
                out.clear()
                size = 0

        def end() -> None:
            if script is not None:
                put(script.rest())
                if not turns:
                    out.append((conv, digest.sha.hexdigest()))

        for conv_id, audit, role, text, copies in _records(batches):
            if audit is not None:
                end()
                conv, script, digest = conv_id, Repaired(audit), Digest()
            elif copies:
                put(script.rows(role, text, copies))
            yield from full()
        end()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kind)

    return each


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows, in one partition."""
    own = audits.select(F.col("conv_id").alias("_conv"))
    of = rows.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"), ("copies", "bigint"), ("digest", "binary"))]
    both = audits.select("conv_id", "audit", *empty).unionByName(of.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", "digest"))
    whose = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    return both.repartition(whose).sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest").select("conv_id", "audit", "role", "text", "copies")


def repair(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 (of the repaired role:text lines) of each conversation.
    copies: how often a row counts (default 1; 0 for rows that are gone, whose conversation is reported nevertheless)."""
    rows = sorted_rows(conversations, copies)
    order = rows.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    parsed = materialise(order.select(*ROW).mapInArrow(_parsed, OUT), "repair-parsed")
    names = ["conv_id", *(x.split(" ")[0] for x in RESULT.split(", "))]
    parts = parsed.where("part IS NOT NULL").withColumn("whose", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    audits = materialise(parts.groupBy("whose").applyInPandas(_joined_parts, f"conv_id bigint, {RESULT}"), "repair-audits")
    digests = _in_order(rows, audits).mapInArrow(_followed(False), "conv_id bigint, sha256 string").toDF("_conv", "sha256")
    long = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*names, "sha256")
    return parsed.where("part IS NULL").select(*names, "sha256").unionByName(long)


def repaired_turns(conversations: DataFrame, repairs: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, at, role, text: the conversations as the audits of repair() leave them."""
    return _in_order(sorted_rows(conversations, copies), repairs).mapInArrow(_followed(True), "conv_id bigint, at bigint, role string, text string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with their damage done, and how often each counts."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), how.alias("how"))
    return rows, F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the repair of every damaged conversation."""
    rows, copies = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(rows, copies).withColumnRenamed("sha256", "repaired_sha256")
