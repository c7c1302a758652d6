"""Repair of conversations: a weighted grammar over spans of turns, least cost and edits of every span."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandloom.llm.common import join_counted, scan, stage

#: Most turns and bytes of a conversation that is repaired in one go.
WHOLE_TURNS, WHOLE_BYTES = 4096, 4 << 20
#: Most different turns and bytes of a block of a longer one.
BLOCK_TURNS, BLOCK_BYTES = 1024, 1 << 20
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

# The roles to be had: (s?(ua)+)?  Before anything, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ACCEPTING = range(4), (0, 3)

#: A span's cell: for every nonterminal (p, q), the turns that lead from state p to q, its least (cost, audit).
Cell = dict[tuple[int, int], tuple[int, str]]


def joined(a: Cell, b: Cell) -> Cell:
    """The cell of two spans in a row, by the rules (p, q) -> (p, r) (r, q).

    A lesser audit of equal cost stays lesser whatever follows: audits of one span and cost are
    never the begin of each other, since what one has more would be insertions, which cost.
    """
    out: Cell = {}
    for (p, r), (c, x) in a.items():
        for (s, q), (d, y) in b.items():
            if r == s and ((p, q) not in out or (c + d, x + y) < out[p, q]):
                out[p, q] = c + d, x + y
    return out


def _closure() -> Cell:
    """Insertions before, between and after turns: no turn at all, or chains of inserted ones."""
    none: Cell = {(p, p): (0, "") for p in STATES}
    step = none | {(p, q): (INSERT, "I") for (p, i), q in STEPS.items() if i != "s"}
    for _ in STATES:
        none = joined(none, step)
    return none


INSERTED = _closure()


@cache
def turn_cell(kind: str) -> Cell:
    """The cell of one turn: ``d`` must go; else its role's initial (s, u, a, or o for others), a capital if it is truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if kind != "d":
        more = CUT * kind.isupper()
        for (p, i), q in STEPS.items():
            if i == kind.lower():
                cell[p, q] = KEEP + more, "K"
            elif i != "s":
                cell[p, q] = REROLE + more, "R"
    return joined(joined(INSERTED, cell), INSERTED)


class Spans:
    """Cells of spans, combined bottom-up: of one turn, of two, of four and so on.

    Any split of a span gives its cell, since every pair of states is a nonterminal, so each span is
    combined once.  Spans that look alike share a cell, found by the cells it was made of.
    """

    MOST = 1 << 16

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.cells: list[Cell] = []
        self.turns: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}

    def cell(self, kinds: list[tuple[str, int]]) -> Cell:
        """The cell of turns given as kinds and how often each follows itself."""
        if len(self.cells) > self.MOST:
            self.forget()
        level = [self._repeated(kind, n) for kind, n in kinds]
        while len(level) > 1:
            pairs = [self._pair(a, b) for a, b in zip(level[::2], level[1::2])]
            level = pairs + level[len(pairs) * 2 :]
        return self.cells[level[0]] if level else INSERTED

    def _turn(self, kind: str) -> int:
        if kind not in self.turns:
            self.turns[kind] = len(self.cells)
            self.cells.append(turn_cell(kind))
        return self.turns[kind]

    def _pair(self, a: int, b: int) -> int:
        if (a, b) not in self.pairs:
            self.pairs[a, b] = len(self.cells)
            self.cells.append(joined(self.cells[a], self.cells[b]))
        return self.pairs[a, b]

    def _repeated(self, kind: str, n: int) -> int:
        power, out = self._turn(kind), None
        while n:
            if n & 1:
                out = power if out is None else self._pair(power, out)
            n >>= 1
            if n:
                power = self._pair(power, power)
        return out


def initial(role: str) -> str:
    return role[:1] or " "


@dataclass
class Block:
    """Turns in a row: counts, what meets the neighbours, the cell, and the turns themselves."""

    faults: tuple[int, int, int] = (0, 0, 0)  # blank, duplicate, truncated
    illegal: int = 0
    turns: int = 0  # different ones, nulls apart
    low: int | None = None
    high: int | None = None
    begins: str = ""  # initials
    ends: str = ""
    cell: Cell = field(default_factory=dict)
    rows: list[tuple[str, str, int]] = field(default_factory=list)  # role, text, times


def block_of(rows: list[tuple[int | None, str, str, int, bool]], spans: Spans) -> Block:
    """The block of turns (turn, role, text, times, whether an earlier one is alike), in order."""
    blank = duplicate = truncated = illegal = turns = 0
    kinds: list[tuple[str, int]] = []
    last_turn, last = None, ""
    for turn, role, text, times, earlier in rows:
        head, body = initial(role), text.rstrip(BLANKS)
        if not body:
            blank += times
            kinds.append(("d", times))
        else:
            again = times - (not earlier)
            duplicate += again
            if not earlier:
                cut = body[-1] not in ENDS
                truncated += cut
                kind = head if head in "sua" else "o"
                kinds.append((kind.upper() if cut else kind, 1))
            if again:
                kinds.append(("d", again))
        illegal += (last + head not in ("su", "ua", "au") if last else 0) + times - 1
        last = head
        turns += turn is not None and turn != last_turn
        last_turn = turn
    known = [r[0] for r in rows if r[0] is not None]
    return Block((blank, duplicate, truncated), illegal, turns, min(known, default=None), max(known, default=None), initial(rows[0][1]), last, spans.cell(kinds), [r[1:4] for r in rows])


def repaired(rows: list[tuple[str, str, int]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits make of turns (role, text, times), from a state on; deleted turns are left out."""
    left = iter(rows)
    role, text, times = "", "", 0
    for edit in audit:
        if edit != "I":
            if not times:
                role, text, times = next(left)
            times -= 1
            if edit == "D":
                continue
        if edit == "K":
            yield edit, role, text
            state = STEPS[state, initial(role)]
        else:
            made = "assistant" if state == 2 else "user"
            yield edit, made, "" if edit == "I" else text
            state = STEPS[state, made[0]]


#: Audits of the blocks so far, the last one first: (all before, last).
Trail = tuple["Trail", str] | None


def tails(a: Trail, b: Trail) -> tuple[str, str]:
    """What two trails of equally many blocks do not share at their begin."""
    x: list[str] = []
    y: list[str] = []
    while a is not b:
        (a, u), (b, v) = a, b
        x.append(u)
        y.append(v)
    return "".join(reversed(x)), "".join(reversed(y))


def whole(trail: Trail) -> str:
    out = []
    while trail is not None:
        trail, audit = trail
        out.append(audit)
    return "".join(reversed(out))


class Fold:
    """A conversation from its blocks in order: of every state the least cost, its audit and the hash of what it gives."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.turns, self.low, self.high, self.ends = [0, 0, 0], 0, 0, None, None, ""
        self.best = {0: (0, None, hashlib.sha256(), True)}  # cost, trail, hash of the repaired turns, whether there are none

    def add(self, b: Block) -> None:
        self.faults = [x + y for x, y in zip(self.faults, b.faults)]
        self.illegal += b.illegal + (bool(self.ends) and self.ends + b.begins not in ("su", "ua", "au"))
        self.turns += b.turns - (b.turns > 0 and self.high == b.low)
        self.low, self.high, self.ends = (self.low if self.low is not None else b.low), (b.high if b.high is not None else self.high), b.ends
        new: dict[int, tuple[int, Trail, int]] = {}
        for (p, q), (cost, audit) in b.cell.items():
            if p in self.best:
                way = self.best[p][0] + cost, (self.best[p][1], audit), p
                if q not in new or way[0] < new[q][0] or (way[0] == new[q][0] and tails(way[1], new[q][1])[0] < tails(way[1], new[q][1])[1]):
                    new[q] = way
        best = {}
        for q, (cost, trail, p) in new.items():
            sha, none = self.best[p][2].copy(), self.best[p][3]
            for _, role, text in repaired(b.rows, trail[1], p):
                sha.update(f"{'' if none else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                none = False
            best[q] = cost, trail, sha, none
        self.best = best

    def row(self) -> tuple[int, int, int, int, int, int, str, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        cost, audit, sha = min((c, whole(t), s.hexdigest()) for q, (c, t, s, _) in self.best.items() if q in ACCEPTING)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults, self.illegal, cost, audit, sha)


OUT = [*(StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
PLAIN = ["_conv", "_turn", "_role", "_text"]


def _emit(convs: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in OUT]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([convs, *(pa.array(c, t) for c, t in zip(columns, kinds))], [f"c{i}" for i in range(9)])


def _whole(rows: DataFrame, schema: StructType) -> DataFrame:
    """Conversations of bounded size, each repaired as one block."""
    kind = schema[0].dataType

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        spans, at, held, seen = Spans(), object(), [], set()
        convs: list = []
        rows: list[tuple] = []

        def close() -> None:
            fold = Fold()
            if held:
                fold.add(block_of(held, spans))
            convs.append(at)
            rows.append(fold.row())

        opened = False
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not opened or conv != at:
                    if opened:
                        close()
                    opened, at, held, seen = True, conv, [], set()
                if text is not None:  # else a mark that the conversation was there
                    held.append((turn, role, text, 1, (role, text) in seen))
                    seen.add((role, text))
            yield _emit(pa.array(convs, to_arrow_type(kind)), rows)
            convs, rows = [], []
        if opened:
            close()
            yield _emit(pa.array(convs, to_arrow_type(kind)), rows)

    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", F.asc_nulls_first("_turn"), "_role", "_text")
    return scan(dealt.select(*PLAIN), repair, schema)


def _blocks(rows: DataFrame, conv: StructField) -> DataFrame:
    """Blocks of the turns of long conversations: ``c0`` the conversation, ``c1, c2`` its place, then the block's fields.

    Turns that agree in all are one row with a count before anything else is done.  The first place
    of each role and text tells which turns repeat an earlier one.  Ranges of turns are cut into blocks
    wherever they lie, so one conversation keeps all tasks busy.
    """
    merged = rows.groupBy(*PLAIN).agg(F.count(F.lit(1)).alias("_n"))
    place = F.struct(F.col("_turn").isNotNull().alias("known"), F.coalesce("_turn", F.lit(0)).cast("long").alias("turn"))
    merged = stage(merged.withColumn("_place", place).withColumn("_like", F.sha2(F.to_json(F.struct("_conv", "_role", "_text")), 256)), "long-turns")
    firsts = merged.groupBy("_like").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_many")).withColumnRenamed("_like", "_same")
    met = join_counted(merged, firsts, "_like", "_same", "_many", ["_conv", "_turn"])
    met = met.select(*PLAIN, "_n", (F.col("_first") != F.col("_place")).alias("_earlier"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartitionByRange(parts, F.col("_conv"), F.asc_nulls_first("_turn"), F.col("_role"), F.substring("_text", 1, 32)).sortWithinPartitions("_conv", F.asc_nulls_first("_turn"), "_role", "_text")
    numbers = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
    listed = (("begins", pa.string()), ("ends", pa.string()), ("from", pa.list_(pa.int32())), ("to", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("times", pa.list_(pa.int64())))
    ddl = "begins string, ends string, `from` array<int>, `to` array<int>, costs array<long>, audits array<string>, roles array<string>, texts array<string>, times array<long>"
    schema = StructType([conv, StructField("part", LongType()), StructField("block", LongType()), *(StructField(c, LongType()) for c in numbers), *StructType.fromDDL(ddl)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        part, number, spans = TaskContext.get().partitionId(), 0, Spans()
        held: list[tuple] = []
        at, size = None, 0

        def close() -> pa.RecordBatch:
            b = block_of(held, spans)
            (p, q), (cost, audit) = zip(*b.cell), zip(*b.cell.values())
            values = [[at], [part], [number], *([v] for v in (*b.faults, b.illegal, b.turns, b.low, b.high)), [b.begins], [b.ends], [list(p)], [list(q)], [list(cost)], [list(audit)], *([list(v)] for v in zip(*b.rows))]
            kinds = [to_arrow_type(conv.dataType), *[pa.int64()] * 9, *(t for _, t in listed)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], [f"c{i}" for i in range(len(kinds))])

        for batch in batches:
            for own, turn, role, text, times, earlier in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and (own != at or len(held) >= BLOCK_TURNS or size >= BLOCK_BYTES):
                    yield close()
                    number += 1
                    held, size = [], 0
                at = own
                held.append((turn, role, text, times, earlier))
                size += len(text)
        if held:
            yield close()

    return scan(dealt, cut, schema)


def _long(rows: DataFrame, schema: StructType) -> DataFrame:
    """Conversations of any length: blocks in parallel, then one fold over the blocks of each, which holds one block at a time."""
    blocks = stage(_blocks(rows, schema[0]), "long-blocks")
    kind = schema[0].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        at, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, _, blank, duplicate, truncated, illegal, turns, low, high, begins, ends, p, q, cost, audit, roles, texts, times = (batch.column(j)[i].as_py() for j in range(19))
                if state is not None and conv != at:
                    yield _emit(pa.array([at], to_arrow_type(kind)), [state.row()])
                    state = None
                at, state = conv, state or Fold()
                state.add(Block((blank, duplicate, truncated), illegal, turns, low, high, begins, ends, dict(zip(zip(p, q), zip(cost, audit))), list(zip(roles, texts, times))))
        if state is not None:
            yield _emit(pa.array([at], to_arrow_type(kind)), [state.row()])

    dealt = blocks.repartition(F.col(blocks.columns[0])).sortWithinPartitions(F.col(blocks.columns[0]), "part", "block")
    return scan(dealt, fold, schema)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col, turn_col, role_col, text_col`` with planted faults, to try the repair on; nulls count as one space.

    By crc32 of ``conv:turn`` modulo 20: 0 drops the turn (a row of a null text marks that its
    conversation was there), 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    body = F.when(h == 1, "").when(h == 2, F.translate(text(text_col), ENDS, "")).when(h > 0, text(text_col))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1)))
    return turns.select(conv_col, turn_col, F.when(h == 4, "user").otherwise(text(role_col)).alias(role_col), body.alias(text_col), copies.alias("_copy")).drop("_copy")


def repair_conversations(
    turns: DataFrame, whole_turns: int = WHOLE_TURNS, whole_bytes: int = WHOLE_BYTES, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: what is wrong with it, and the cheapest edits that make its roles ``(s?(ua)+)?``.

    Turns stand in the order of ``turn_col``, nulls first, then role and text.  The first fault of each
    counts: ``blank`` (no sign but white space), ``duplicate`` (role and text as of an earlier one),
    ``truncated`` (the last sign ends no sentence).  ``illegal`` counts neighbours whose roles' initials
    are not su, ua or au; ``gaps`` the turn numbers missing between the least and the greatest.
    Keeping a turn costs 0, giving it the role user or assistant 2, deleting it 3, which blank and
    duplicate ones must be, and inserting an empty turn 2; a truncated turn that stays adds 1.
    ``cost`` is the least sum, ``audit`` the initials K, R, D, I of its edits in order (of several the
    least), ``repaired_sha256`` that of the repaired ``role:text`` lines; the texts are never gathered.

    Conversations of more than ``whole_turns`` turns or ``whole_bytes`` bytes are cut into blocks all over
    the cluster, and one task folds their cells; the result is the same.

    A row of a null text only tells that its conversation exists: one without other rows has zeros, an empty
    audit and the hash of the empty text.  A null role counts as one space, an empty one alike; null
    conversations are one; an empty table gives no rows; other columns are left out.
    """
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("_role"), F.col(text_col).alias("_text"))
    schema = StructType([StructField(conv_col, turns.schema[conv_col].dataType), *OUT])
    sizes = rows.groupBy("_conv").agg(F.count("_text").alias("n"), F.sum(F.octet_length("_text") + F.octet_length("_role")).alias("bytes"))
    large = stage(sizes.filter((F.col("n") > whole_turns) | (F.col("bytes") > whole_bytes)).select(F.col("_conv").alias("_large")), "long-conversations")
    if large.isEmpty():
        return _whole(rows, schema)
    is_large = F.col("_conv").eqNullSafe(F.col("_large"))
    return _whole(rows.join(large, is_large, "left_anti"), schema).unionByName(_long(rows.join(large, is_large, "left_semi").filter("_text IS NOT NULL"), schema))
