"""Scans of a dictionary by its own strings: one row for a run of windows is shuffled, which is known and asked at once, on both strands.

Letters are packed four a byte, and no k-mer, no second side and no reversed read is shuffled, so what lies on disk is a
small part of what is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandloom.functions import reverse_complement
from strandloom.operators import seeds
from strandloom.operators.lookups import MET, _answers, _first_places, met_columns, same_key
from strandloom.operators.windows import chunk_runs, chunks, keyed_pieces, piece_kmers, piece_windows, query_pieces, spread, unfold
from strandloom.staging import not_broadcast, staged

#: Groups of minimizers whose windows are counted; a group is heavy above so many windows, and so many times the mean.
GROUPS, HEAVY, TIMES = 1 << 16, 1 << 18, 8
#: The columns that tell a string.
OWN = ["_sid", "_begin", "_end"]
NONE = np.iinfo(np.int64).max

Work = Callable[[pa.RecordBatch], pa.RecordBatch]


def own_runs(strings: DataFrame, k: int) -> DataFrame:
    """The runs of windows of a string set, with its further columns; letters are written once, in chunks."""
    names = dict(zip(("string_id", "string_begin", "string_end"), OWN))
    own = strings.withColumnsRenamed(names)
    keep = [c for c in own.columns if c != "seq"]
    return chunk_runs(staged(chunks(own, k, keep), "own-chunks"), k, keep, folded=True)


def _whole(work: Work) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies ``work`` to batches of sorted runs that hold each minimizer's runs whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            minimizer = batch.column("_minimizer").to_numpy()
            if held and minimizer[-1] != last:
                cut = int(np.searchsorted(minimizer, minimizer[-1]))
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = minimizer[-1]
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


class _Met:
    """The windows of runs, and the first places (``NONE`` if there is none) where each stands, ``same``, and its reverse complement, ``turned``."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        self.batch, self.pieces = batch, unfold(batch.column("_piece"))
        self.begin, end = batch.column("_begin").to_numpy(), batch.column("_end").to_numpy()
        self.row, self.place, limbs, own = piece_windows(self.pieces, k)
        self.pos = batch.column("_at").to_numpy().astype(np.int64)[self.row] + self.place
        self.offset, self.back = self.begin[self.row] + self.pos, (end - self.begin)[self.row] - k - self.pos
        order = np.argsort(limbs[0]) if len(limbs) == 1 else np.lexsort(limbs)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in limbs], axis=0)
        group, starts = np.empty(len(order), np.int64), np.flatnonzero(new)
        group[order] = np.cumsum(new) - 1
        first, second = (np.minimum.reduceat(np.where(own == side, self.offset, NONE)[order], starts)[group] for side in (True, False))
        self.same, self.turned = np.where(own, first, second), np.where(own, second, first)

    def strings(self, place: np.ndarray) -> list[np.ndarray]:
        """``OWN`` of the strings that hold places: they do not overlap, so the last one that begins up to a place."""
        order = np.argsort(self.begin)
        at = order[np.searchsorted(self.begin[order], place, "right") - 1]
        return [self.batch.column(c).to_numpy()[at] for c in OWN]

    def kept(self, keep: list[str], row: np.ndarray) -> list[pa.Array]:
        return [self.batch.column(c).take(pa.array(row)) for c in keep]


def _parted(runs: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """The runs of light minimizers, and those of heavy ones, if there are any.  Minimizers are counted by groups, so that little is shuffled."""
    group = F.pmod(F.col("_minimizer"), F.lit(GROUPS)).cast("int")
    sizes = runs.groupBy(group.alias("g")).agg(F.sum("_size").alias("n")).collect()  # GROUPS rows at most
    mean = sum(r.n for r in sizes) // GROUPS
    heavy = [r.g for r in sizes if r.n > least + TIMES * mean]
    return (runs.filter(~group.isin(heavy)), staged(runs.filter(group.isin(heavy)), "heavy-runs")) if heavy else (runs, None)


def _meet(light: DataFrame, work: Work, schema: StructType) -> DataFrame:
    return spread(light.drop("_size"), "_minimizer").sortWithinPartitions("_minimizer").mapInArrow(_whole(work), schema)


def _keyed(heavy: DataFrame, k: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The windows of heavy runs (``pos`` in their string), and the index of their k-mers: by minima that combine before the shuffle."""
    pieces = heavy.withColumnRenamed("_piece", "seq")
    rows = keyed_pieces(pieces, k, [*OWN, "_at"])
    names = zip(OWN, ("string_id", "string_begin", "string_end"))
    place = (F.col("_begin") + F.col("_at") + F.col("pos")).cast("bigint").alias("kmer_offset")
    index = _first_places(rows.select("key", "own", place, *(F.col(c).alias(name) for c, name in names)), k)
    return query_pieces(pieces, k, [*keep, *OWN, "_at"]).withColumn("pos", F.col("_at") + F.col("pos")), index


def lookup_own(strings: DataFrame, k: int, canonical_mode: bool = False, least: int = HEAVY) -> DataFrame:
    """``lookup_windows`` of the strings themselves (their further columns are kept), each in the set of all."""
    runs = own_runs(strings, k)
    keep = [c for c in strings.columns if c not in ("seq", "string_id", "string_begin", "string_end")]
    light, heavy = _parted(runs, least)

    def answers(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _Met(batch, k)
        forward = (m.same <= m.turned) | (not canonical_mode)
        found = np.where(forward, m.same, m.turned)
        sid, begin, end = m.strings(found)
        turn = pa.array(np.where(forward, 1, -1), pa.int32())
        made = [pa.array(m.pos, pa.int32()), piece_kmers(m.pieces, m.row, m.place, k), turn, *map(pa.array, (found, sid, begin, end))]
        return pa.RecordBatch.from_arrays([*m.kept(keep, m.row), *made], [*keep, *MET])

    schema = StructType([*(strings.schema[c] for c in keep), *(StructField(c, kind) for c, kind in MET.items())])
    found = met_columns(_meet(light, answers, schema), keep, k)
    if heavy is None:
        return found
    q, index = _keyed(heavy, k, keep)
    return found.unionByName(_answers(q, [*keep, "pos", "kmer", "valid"], index, k, canonical_mode))


def lookup_both_strands(strings: DataFrame, k: int, canonical_mode: bool = True, least: int = HEAVY) -> DataFrame:
    """Of every window of the strings, read forward and (``turned``) as their reverse complements, the first place: the
    further columns, ``turned, pos, kmer_offset, orientation``."""
    runs = own_runs(strings, k)
    keep = [c for c in strings.columns if c not in ("seq", "string_id", "string_begin", "string_end")]
    light, heavy = _parted(runs, least)

    def answers(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _Met(batch, k)
        sides = []
        for same, turned in ((m.same, m.turned), (m.turned, m.same)):
            forward = (same < NONE) & ((same <= turned) | (not canonical_mode))
            sides.append((np.where(forward, same, turned), np.where(forward, 1, -1)))
        found, turn = (np.concatenate(x) for x in zip(*sides))
        row = np.concatenate([m.row, m.row])
        made = [pa.array(np.arange(len(row)) >= len(m.row)), pa.array(np.concatenate([m.pos, m.back]), pa.int32()), pa.array(found), pa.array(turn, pa.int32())]
        return pa.RecordBatch.from_arrays([*m.kept(keep, row), *made], [*keep, "turned", "pos", "kmer_offset", "orientation"])

    own = ", ".join(["turned boolean", "pos int", "kmer_offset long", "orientation int"])
    found = _meet(light, answers, StructType([*(strings.schema[c] for c in keep), *StructType.fromDDL(own)]))
    if heavy is None:
        return found
    q, index = _keyed(heavy, k, keep)
    for turned in (False, True):
        mine = q.withColumn("_own", F.col("_own") != F.lit(turned)).withColumn("pos", F.when(F.lit(turned), F.col("_end") - F.col("_begin") - k - F.col("pos")).otherwise(F.col("pos")).cast("int"))
        rows = _answers(mine, [*keep, "pos"], index, k, canonical_mode).select(*keep, F.lit(turned).alias("turned"), "pos", "kmer_offset", "orientation")
        found = found.unionByName(rows)
    return found


#: A stretch of windows of a read whose first places lie on one diagonal, off the read's own string.
FOREIGN = "query_id long, a long, b long, off long, orientation long, string_id long, string_begin long, string_end long"


def _foreign(runs: DataFrame, k: int, least: int) -> DataFrame:
    """``FOREIGN`` of both strands of the strings: ``query_id`` is the string's id, or -1 less it for the reverse complement.

    Only windows whose first place is not their own are told; stretches end where runs of windows do.
    """
    light, heavy = _parted(runs, least)
    schema = StructType.fromDDL(FOREIGN)

    def answers(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _Met(batch, k)
        own = batch.column("_sid").to_numpy()[m.row]
        columns = []
        for back in (False, True):
            plus = (m.turned < NONE) if back else np.ones(len(own), bool)
            off, turn = np.where(plus, m.turned if back else m.same, m.same), np.where(plus, 1, -1)
            mine = np.flatnonzero((off != m.offset) | (plus & back))
            off, turn, row, place = off[mine], turn[mine], m.row[mine], m.place[mine]
            sid, begin, end = m.strings(off)
            step = -turn if back else turn  # along the string, from one window here to the next
            new = np.ones(len(mine), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (turn[1:] != turn[:-1]) | (sid[1:] != sid[:-1]) | (off[1:] != off[:-1] + step[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(mine)) - 1 if len(mine) else first
            if back:
                first, last = last, first
            pos = (m.back if back else m.pos)[mine]
            read = own[mine][first]
            columns.append([-1 - read if back else read, pos[first], pos[last], off[first], turn[first], sid[first], begin[first], end[first]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*columns)], schema.names)

    found = _meet(light, answers, schema)
    if heavy is None:
        return found
    q, index = _keyed(heavy, k, [])
    joined = q.join(not_broadcast(index), same_key(F.col("_key"), k))
    same, turned = (F.when(F.col("_own") == side, F.col("fwd")).otherwise(F.col("rev")) for side in (True, False))
    place = F.col("_begin") + F.col("pos")
    for back in (False, True):
        hit = F.coalesce(turned, same) if back else same
        plus = turned.isNotNull() if back else F.lit(True)
        pos = F.col("_end") - F.col("_begin") - k - F.col("pos") if back else F.col("pos")
        rows = joined.select((-1 - F.col("_sid") if back else F.col("_sid")).alias("query_id"), pos.cast("long").alias("a"), place.alias("_place"), hit.alias("_hit"), plus.alias("_plus"))
        rows = rows.filter((F.col("_hit.kmer_offset") != F.col("_place")) | (F.col("_plus") & F.lit(back)))
        found = found.unionByName(rows.select(
            "query_id", "a", F.col("a").alias("b"), F.col("_hit.kmer_offset").alias("off"), F.when(F.col("_plus"), 1).otherwise(-1).cast("long").alias("orientation"),
            *[F.col(f"_hit.{c}").alias(c) for c in ("string_id", "string_begin", "string_end")],
        ))
    return found


def _heads(found: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The stretches before the first window of a read that is its own first place, with ``_block``; and ``query_id, _own``, that window, where it is not the first.

    A block of a read is looked at alone, and then the blocks that are covered whole.
    """
    own = Window.partitionBy("query_id", "_block").orderBy("a")
    size = F.col("b") - F.col("a") + 1
    before = F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.greatest(F.col("a"), F.col("_block") * block)  # the blocks of a turned read are not those of its chunks
    cut = found.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block)))).withColumn("_a", first)
    cut = cut.withColumn("off", F.col("off") + F.col("orientation") * (F.col("_a") - F.col("a"))).withColumn("b", F.least(F.col("b"), F.col("_block") * block + block - 1)).withColumn("a", F.col("_a")).drop("_a")
    rows = cut.withColumn("_before", before).filter(F.col("_before") == F.col("a") - F.col("_block") * block).drop("_before")
    rows = staged(rows, "own-heads")
    blocks = rows.groupBy("query_id", "_block").agg(F.sum(size).alias("_n"))
    along = Window.partitionBy("query_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).filter(F.col("_before") == F.col("_block") * block)
    ends = blocks.groupBy("query_id").agg(F.sum("_n").alias("_own"))
    reached = blocks.select(F.col("query_id").alias("_q"), F.col("_block").alias("_b"))
    return rows.join(not_broadcast(reached), (F.col("query_id") == F.col("_q")) & (F.col("_block") == F.col("_b")), "left_semi"), ends


def _joined(rows: DataFrame) -> DataFrame:
    """Stretches of one diagonal that follow one another in a block as one."""
    own = Window.partitionBy("query_id", "_block").orderBy("a")
    prev = lambda c: F.lag(c).over(own)
    on = prev("off") + F.col("orientation") * (F.col("a") - prev("a"))
    follows = (prev("b") == F.col("a") - 1) & (prev("string_id") == F.col("string_id")) & (prev("orientation") == F.col("orientation")) & (on == F.col("off"))
    marked = rows.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_seg", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("query_id", "_block", "_seg").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("off", "a").alias("off"), *[F.min(c).alias(c) for c in ("orientation", "string_id", "string_begin", "string_end")]
    ).drop("_seg")


def both_strands(strings: DataFrame) -> DataFrame:
    """``query_id, seq``: strings as reads, and their reverse complements, with -1 less the string's id."""
    own = strings.select(F.col("string_id").alias("query_id"), "seq")
    return own.unionByName(own.select((-1 - F.col("query_id")).alias("query_id"), reverse_complement(F.col("seq")).alias("seq")))


def own_searches(strings: DataFrame, k: int, block: int = seeds.BLOCK, least: int = HEAVY) -> DataFrame:
    """``seeds.seeded_runs`` of the strings and their reverse complements (``query_id`` -1 less the string's) in the set itself.

    Each window is found, at its own place at the latest.  From a window whose first place is its own the string is followed to its
    end.  A stretch on another place holds no such window, since all it agrees with stands there too, earlier or turned.
    So only the stretches before a read's first own window have to be followed, and one search from there takes the rest.
    """
    strings = strings.select("string_id", "string_begin", "string_end", "seq")
    heads, ends = _heads(_foreign(own_runs(strings, k), k, least), block)
    ends = staged(ends, "own-ends")
    segs = not_broadcast(_joined(heads)).join(ends.select(F.col("query_id").alias("_q"), "_own"), F.col("query_id") == F.col("_q"))
    segs = staged(segs.withColumn("_alone", F.col("b") + 1 == F.col("_own")).drop("_q", "_own"), "own-segments")
    # Only strings that are followed, or that follow, have to give their letters.
    open_ = segs.filter("NOT _alone")
    read = F.when(F.col("query_id") < 0, -1 - F.col("query_id")).otherwise(F.col("query_id"))
    wanted = open_.select(F.explode(F.array(read, "string_id")).alias("_s")).distinct()
    some = staged(strings.join(wanted, F.col("string_id") == F.col("_s"), "left_semi"), "own-followed")
    led = seeds.followed_runs(segs, both_strands(some), some, k)
    return led.unionByName(_rest(strings, ends, k))


def _rest(strings: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """The search from each read's first own window on."""
    windows = F.col("string_end") - F.col("string_begin") - k + 1
    sides = F.explode(F.array(F.struct(F.col("string_id").alias("query_id"), F.lit(1).cast("long").alias("orientation")), F.struct((-1 - F.col("string_id")).alias("query_id"), F.lit(-1).cast("long").alias("orientation"))))
    reads = strings.select("string_id", "string_begin", windows.alias("_n"), sides.alias("_r")).select("string_id", "string_begin", "_n", "_r.*")
    rows = not_broadcast(reads).join(ends.select(F.col("query_id").alias("_q"), "_own"), F.col("query_id") == F.col("_q"), "left").withColumn("first_pos", F.coalesce("_own", F.lit(0)))
    place = F.col("string_begin") + F.when(F.col("orientation") > 0, F.col("first_pos")).otherwise(F.col("_n") - 1 - F.col("first_pos"))
    return rows.filter("first_pos < _n").select("query_id", "first_pos", (F.col("_n") - F.col("first_pos")).alias("num_kmers"), place.alias("kmer_offset"), "orientation", "string_id")


def own_stats(strings: DataFrame, searches: DataFrame, k: int) -> DataFrame:
    """One row, as ``scan.scan_stats`` gives: the counters of a scan of the strings and their reverse complements, of which every window is found."""
    total = F.coalesce(F.sum(F.col("string_end") - F.col("string_begin") - k + 1), F.lit(0)) * 2
    none = F.lit(0).cast("long")
    windows = strings.agg(total.alias("windows"))
    searched = searches.agg(F.count(F.lit(1)).alias("searches"), F.coalesce(F.sum(F.col("num_kmers") - 1), F.lit(0)).alias("extensions"))
    rate = F.when(F.col("windows") > 0, F.round(F.col("windows") * 100.0 / F.col("windows"), 6))
    return windows.join(F.broadcast(searched)).select(
        "windows", F.col("windows").alias("found"), none.alias("not_found"), rate.alias("hit_rate"), "searches", "extensions", none.alias("invalid"), none.alias("negative")
    )
