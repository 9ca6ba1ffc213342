"""Conversation repair: the cheapest edits that turn the rows of a conversation into ``s?(ua)+`` or nothing, by interval parsing.

The grammar is in Chomsky normal form. A nonterminal says what a span of rows becomes: nothing, or a part of a good
conversation with its first and last role; ``X -> Y Z`` holds where Z's part may follow Y's (PRODUCTS). A row is a
terminal: kept, given another role or deleted, each at its cost. Any number of new turns may stand in any gap: the
closure of each row's cell under insertion on both sides. A cell holds per nonterminal the least (cost, audit), the
audit being the edits' initials in order.

Of equal costs over one span neither audit is the beginning of the other (the longer would hold more insertions, each
with a cost), so the least audits of two spans make the least audit of both, and cells compose. As each part of a good
conversation can be cut in any place and both sides have nonterminals of their own, one cut of a span gives what all
its cuts give. So the chart has spans of 1, 2, 4, 8, ... rows only, combined bottom-up by length, and a conversation may
be parsed in pieces by many tasks, whose cells are combined in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from barweave.llm.batches import pieces_of

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 3), ("D", 4), ("I", 3)
TRUNCATED_COST = 3
EMPTY, SYSTEM = "", "s"
PARTS = (EMPTY, "uu", "ua", "au", "aa", SYSTEM, "su", "sa")  # nothing; first and last role; a system turn and the last role
AT = {x: i for i, x in enumerate(PARTS)}
GOAL = (AT[EMPTY], AT["ua"], AT["sa"])
Cell = tuple[tuple[int, str] | None, ...]


def _follows(y: str, z: str) -> str | None:
    """The nonterminal of Y's part and then Z's, if there is one."""
    if not y or not z:
        return y or z
    if z[0] == SYSTEM or (y != SYSTEM and y[-1] == z[0]) or (y == SYSTEM and z[0] != "u"):
        return None
    return y[0] + z[-1]


PRODUCTS = tuple((AT[y], AT[z], AT[x]) for y in PARTS for z in PARTS if (x := _follows(y, z)) is not None)


def combined(left: Cell, right: Cell) -> Cell:
    out: list[tuple[int, str] | None] = [None] * len(PARTS)
    for y, z, x in PRODUCTS:
        if (a := left[y]) and (b := right[z]):
            cost, best = a[0] + b[0], out[x]
            if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                out[x] = (cost, a[1] + b[1])
    return tuple(out)


def _cell(**parts: tuple[int, str]) -> Cell:
    return tuple(parts.get(x or "nothing") for x in PARTS)


_NEW, _BOTH = (INSERT[1], INSERT[0]), (2 * INSERT[1], 2 * INSERT[0])
GAP = _cell(nothing=(0, ""), uu=_NEW, aa=_NEW, ua=_BOTH, au=_BOTH)
GONE = "x"  # a row that must be deleted


@lru_cache(maxsize=1 << 16)
def span(rows: str) -> Cell:
    """The cell of some rows, one letter each: x, or the role's initial (o: any other), upper case if truncated."""
    if len(rows) > 1:
        half = 1 << (len(rows) - 1).bit_length() - 1
        return combined(span(rows[:half]), span(rows[half:]))
    parts = {"nothing": (DELETE[1], DELETE[0])}
    if rows and rows != GONE:
        more = TRUNCATED_COST if rows.isupper() else 0
        for part, role in (("uu", "u"), ("aa", "a")):
            name, cost = KEEP if rows.lower() == role else REROLE
            parts[part] = (cost + more, name)
        if rows.lower() == SYSTEM:
            parts[SYSTEM] = (KEEP[1] + more, KEEP[0])
    return combined(combined(GAP, _cell(**parts)), GAP) if rows else GAP


class Chart:
    """Rows in order; cells of neighbouring spans of one length are combined as soon as both are there."""

    LEAF = 8

    def __init__(self) -> None:
        self.stack: list[tuple[int, Cell]] = []
        self.rows: list[str] = []

    def add(self, row: str, times: int = 1) -> None:
        if times > self.LEAF:
            self._flush()
            cell, size = span(row), 1
            while size <= times:
                if times & size:
                    self.push(size, cell)
                cell, size = combined(cell, cell), 2 * size
            return
        self.rows.extend(row * times)
        while len(self.rows) >= self.LEAF:
            self.push(self.LEAF, span("".join(self.rows[: self.LEAF])))
            del self.rows[: self.LEAF]

    def push(self, size: int, cell: Cell) -> None:
        self.stack.append((size, cell))
        while len(self.stack) > 1 and self.stack[-2][0] <= self.stack[-1][0]:
            (n, right), (m, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((n + m, combined(left, right)))

    def _flush(self) -> None:
        if self.rows:
            self.push(len(self.rows), span("".join(self.rows)))
            self.rows = []

    def cell(self) -> Cell:
        self._flush()
        while len(self.stack) > 1:
            (n, right), (m, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((n + m, combined(left, right)))
        return self.stack[0][1] if self.stack else GAP


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[x] for x in GOAL if cell[x])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that crc32(``conv_id:turn``) % 20 deals: (conv_id, turn, role, text, copies).

    0 drops a row (no copies), 1 empties its text, 2 takes its marks ``.!?``, 3 repeats it, 4 makes its role user. Null
    roles and texts are one space, null ids and turns one space within the number; as ids and turns they stay null.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), said(F.col("role")).alias("role"), said(F.col("text")).alias("text"), dealt.alias("dealt"))
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("dealt") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("dealt") == 0, 0).when(F.col("dealt") == 3, 2).otherwise(1).alias("copies"))


def _content() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


_SEGMENT = {"rows": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first": "string", "last": "string", "low": "long", "high": "long", "turns": "long", "costs": "array<long>", "audits": "array<string>"}
_LEGAL = ("su", "ua", "au")
SEGMENT_ROWS = 4096


class Segment:
    """What must be known of consecutive rows of a conversation: counts, ends and the cell; two neighbours make one."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.chart = Chart()

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, new: bool, copies: int) -> None:
        """A row that stands there ``copies`` times; all but the first, and the first too if not ``new``, are duplicates."""
        if copies <= 0:
            return
        own = initial if initial and initial in "sua" else "o"
        once = int(new and not blank)
        self.blank += copies * blank
        self.duplicate += (copies - once) * (not blank)
        self.truncated += once * truncated
        self._ends(initial, initial, copies - 1)
        self._turns(turn, turn, turn is not None)
        self.rows += copies
        if once:
            self.chart.add(own.upper() if truncated else own)
        if copies > once:
            self.chart.add(GONE, copies - once)

    def _ends(self, first: str, last: str, illegal: int) -> None:
        self.illegal += illegal + (self.rows > 0 and self.last + first not in _LEGAL)
        self.first, self.last = (self.first if self.rows else first), last

    def _turns(self, low: int | None, high: int | None, turns: int) -> None:
        if turns:
            self.turns += turns - (self.high is not None and self.high == low)
            self.low, self.high = (low if self.low is None else self.low), high

    def follow(self, other: dict) -> None:
        """Take on a later segment, as ``values`` gave it."""
        if not other["rows"]:
            return
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + other[name])
        self._ends(other["first"], other["last"], other["illegal"])
        self._turns(other["low"], other["high"], other["turns"])
        self.rows += other["rows"]
        self.chart.push(other["rows"], tuple(None if c is None else (c, a) for c, a in zip(other["costs"], other["audits"], strict=True)))

    def values(self) -> list:
        cell = self.chart.cell()
        return [self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns, [x and x[0] for x in cell], [x and x[1] for x in cell]]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[list], kinds: dict[str, str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_SEGMENTS = {"conv_id": "long", "part": "long", "seg": "long", **_SEGMENT}


def _segments(most: int):
    """Sorted rows to segments of ``most`` distinct rows; a conversation's are in the order of (part, seg)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, conv, seg, size, done = None, None, 0, 0, []
        for piece in pieces_of(batches):
            for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if held is not None and (row[0] != conv or size >= most):
                    done.append([conv, part, seg, *held.values()])
                    held = None
                if held is None:
                    held, seg, size, conv = Segment(), seg + 1, 0, row[0]
                held.add(*row[1:])
                size += 1
            if len(done) >= 256:
                yield _batch(done, _SEGMENTS)
                done = []
        if held is not None:
            done.append([conv, part, seg, *held.values()])
        yield _batch(done, _SEGMENTS)

    return run


def segments(rows: DataFrame, most: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, part, seg, ...): the cells and counts of pieces of conversations; ``rows`` as ``damaged`` gives them.

    Equal rows of a turn are one row with a number before anything is shuffled by conversation; texts stay behind, as
    hashes of role and text tell duplicates. Rows are dealt by ranges of (conversation, turn, hash), so a conversation
    of any length is parsed by many tasks, each holding the cells of one segment.
    """
    spaced = F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    keys = rows.select("conv_id", "turn", _content().alias("content"), F.substring("role", 1, 1).alias("initial"), (~spaced).alias("blank"), cut.alias("cut"), F.col("copies").cast("long").alias("copies"))
    once = keys.groupBy("conv_id", "turn", "content", "initial", "blank", "cut").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.where("copies > 0 and not blank").groupBy(F.col("conv_id").alias("_conv"), F.col("content").alias("_content")).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    found = once.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("content") == F.col("_content")), "left")
    new = F.col("_n").isNull() | (at == F.col("_first")) | (F.col("turn").isNull() & ~F.col("_first.known"))
    order = ("conv_id", "turn", "content")
    dealt = found.select(*order, "initial", "blank", "cut", F.coalesce(new, F.lit(False)).alias("new"), "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.drop("content").mapInArrow(_segments(most), ", ".join(f"{k} {v}" for k, v in _SEGMENTS.items()))


_REPORT = {"conv_id": "long", "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
_REPAIRED = {"conv_id": "long", "position": "long", "edit": "string", "role": "string", "text": "string"}


class Repair:
    """The edits of an audit applied to rows that come one by one: yields (edit, role, text) of the turns that stand."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.out = audit, 0, 0
        self.system = (len(audit) - audit.count(DELETE[0])) % 2

    def _turn(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        self.out += 1
        return edit, role if role is not None else ("user", "assistant")[(self.out - 1 - self.system) % 2], text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT[0]:
            self.at += 1
            yield self._turn(INSERT[0], None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE[0]:
            yield self._turn(edit, role if edit == KEEP[0] else None, text)


def _walk(turns_wanted: bool):
    """Batches sorted by conversation, its segments first, then its rows, to reports or to repaired turns."""
    kinds = _REPAIRED if turns_wanted else _REPORT
    names = ["conv_id", "kind", *_SEGMENT, "role", "text", "copies"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        size = 0
        conv, begun, whole, head, repair, digest, turns = None, False, None, None, None, None, 0

        def said(found: Iterable[tuple[str, str, str]]) -> None:
            nonlocal turns, size
            for edit, role, text in found:
                if turns_wanted:
                    done.append([conv, turns, edit, role, text])
                    size += len(text) + 64
                else:
                    digest.update((b"\n" if turns else b"") + role.encode() + b":" + text.encode())
                turns += 1

        def parsed() -> None:
            nonlocal head, repair
            cost, audit = best(whole.chart.cell())
            head = [whole.gaps(), whole.blank, whole.duplicate, whole.truncated, whole.illegal, cost, audit]
            repair = Repair(audit)

        def closed() -> None:
            nonlocal size
            if head is None:
                parsed()
            said(repair.inserted())
            if not turns_wanted:
                done.append([conv, *head, digest.hexdigest()])
                size += len(head[-1]) + 128

        for piece in pieces_of(batches, 256):
            for values in zip(*(piece.column(i).to_pylist() for i in range(piece.num_columns)), strict=True):
                row = dict(zip(names, values, strict=True))
                if not begun or row["conv_id"] != conv:
                    if begun:
                        closed()
                    begun, conv, whole, head, digest, turns = True, row["conv_id"], Segment(), None, hashlib.sha256(), 0
                if not row["kind"]:
                    whole.follow(row)
                    continue
                if head is None:
                    parsed()
                for _ in range(row["copies"]):
                    said(repair.row(row["role"], row["text"]))
                if size >= 1 << 20:
                    yield _batch(done, kinds)
                    done, size = [], 0
        if begun:
            closed()
        yield _batch(done, kinds)

    return run


def _met(rows: DataFrame, turns_wanted: bool, most: int) -> DataFrame:
    """Segments and texts of a conversation in one sorted stream, whose order makes any join needless."""
    null = lambda names: [F.lit(None).cast(_SEGMENT[x]).alias(x) for x in names]
    cells = segments(rows, most).select("conv_id", F.lit(0).alias("kind"), *_SEGMENT, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "part", "seg", F.lit(None).cast("binary").alias("content"))
    said = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), *null(_SEGMENT), "role", "text", F.col("copies").cast("long").alias("copies"), F.col("turn").alias("part"), F.lit(0).cast("long").alias("seg"), _content().alias("content"))
    ordered = cells.unionByName(said).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seg", "content").drop("part", "seg", "content")
    kinds = _REPAIRED if turns_wanted else _REPORT
    return ordered.mapInArrow(_walk(turns_wanted), ", ".join(f"{k} {v}" for k, v in kinds.items()))


def report(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation its faults, the least cost, the least audit of that cost, and the digest of the repaired turns.

    ``rows``: conv_id, turn, role, text and copies (how often the row stands there; 0: only its conversation counts).
    Rows are in order of turn, nulls first; different rows of one turn in that of their hashes, equal ones next to each
    other. A null conv_id is a conversation too. Nothing is left of a conversation without rows: cost 0, an empty
    audit and the digest of an empty text. A digest is one chain over a conversation's text, so its rows pass one task;
    they stream through it in sorted order and are never held, but for the audit's letters. Other columns aren't read.
    """
    return _met(rows, False, segment_rows)


def repaired(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The turns after repair: conv_id, position from 0, edit (K, R or I), role, text; as ``report`` takes and sorts rows."""
    return _met(rows, True, segment_rows)
