"""Exact lookups: one equality join on the canonical k-mer answers both strands."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from strandloom.functions import is_query_kmer, key_of_order, kmer_of_key, order_key, reverse_complement, reverse_order_key
from strandloom.functions.kmers import LONG_BASES
from strandloom.operators.windows import keyed_pieces, keyed_windows, piece_kmers, piece_windows, query_pieces, query_windows, spread, stretches, super_kmers, unfold, window_keys, window_runs
from strandloom.staging import not_broadcast, staged


def index_kmers(strings: DataFrame, k: int) -> DataFrame:
    """One row per canonical k-mer: ``key`` (``l0, l1, ...`` above 31 bases), and the first place of either strand.

    ``fwd`` is the first place where the canonical form itself is stored, ``rev`` the first
    of its reverse complement, null if there is none.  Equal k-mers are met by their least
    offset, by minima that combine before the shuffle; no bucket is ever gathered.
    """
    place = ["string_id", "string_begin", "string_end"]
    return _first_places(keyed_windows(strings, k, place).withColumn("kmer_offset", (F.col("string_begin") + F.col("pos")).cast("bigint")), k)


def index_chunks(chunks: DataFrame, strings: DataFrame, k: int, size: int) -> DataFrame:
    """The index of records in chunks of ``size`` letters and k - 1 more, with the strings that ``chunked_set`` made of them."""
    own = strings.select(F.col("file").alias("_f"), F.col("record").alias("_r"), "string_id", "string_begin", "string_end")
    rows = chunks.join(not_broadcast(own), (F.col("file") == F.col("_f")) & (F.col("record") == F.col("_r")))
    found = keyed_windows(rows, k, ["string_id", "string_begin", "string_end", "chunk"])
    return _first_places(found.withColumn("kmer_offset", (F.col("string_begin") + F.col("chunk") * size + F.col("pos")).cast("bigint")), k)


def _first_places(rows: DataFrame, k: int) -> DataFrame:
    place = ["string_id", "string_begin", "string_end"]
    # Strings lie in the order of their ids, so all four minima are of one place; being
    # longs and no struct, they are combined in a hash map and nothing is sorted.
    fields = ["kmer_offset", *place]
    lows = [F.min(F.when(F.col("own") == own, F.col(c))).alias(f"{side}_{c}") for side, own in (("fwd", True), ("rev", False)) for c in fields]
    found = rows.groupBy("key").agg(*lows)
    sides = [F.when(F.col(f"{s}_kmer_offset").isNotNull(), F.struct(*[F.col(f"{s}_{c}").alias(c) for c in fields])).alias(s) for s in ("fwd", "rev")]
    return found.select("key" if k <= LONG_BASES else "key.*", *sides)


def repeated_kmers(strings: DataFrame, k: int) -> DataFrame:
    """``kmer, places, first_offset, last_offset`` of every canonical k-mer that is stored more than once, on either strand.

    A string set without such rows is spectrum-preserving.  Counts, minima and maxima are combined
    before the shuffle, so a k-mer of very many places is no hot group.
    """
    rows = keyed_windows(strings, k, ["string_begin"]).withColumn("_at", (F.col("string_begin") + F.col("pos")).cast("bigint"))
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("places"), F.min("_at").alias("first_offset"), F.max("_at").alias("last_offset"))
    return found.filter("places > 1").select(kmer_of_key(F.col("key"), k).alias("kmer"), "places", "first_offset", "last_offset")


def key_columns(k: int) -> list[str]:
    """The columns of an index that hold its key: one long, or a column for each limb, since stored buckets are made of plain columns."""
    return ["key"] if k <= LONG_BASES else [f"l{i}" for i in range(-(-k // LONG_BASES))]


def same_key(key: Column, k: int) -> Column:
    """Whether a join key is that of an index row."""
    names = key_columns(k)
    return key == F.col("key") if names == ["key"] else reduce(lambda x, y: x & y, [key[c] == F.col(c) for c in names])


def lookup(queries: DataFrame, index: DataFrame, k: int, canonical_mode: bool = False) -> DataFrame:
    """``queries`` (with ``kmer``) and where each k-mer is: ``found, kmer_id, kmer_id_in_string,
    kmer_offset, orientation, string_id, string_begin, string_end``; nulls if it is nowhere.

    A k-mer of another length or with other letters is nowhere.  In regular mode the forward
    strand is preferred; in canonical mode the first place of either strand.
    """
    text = F.upper(F.col("kmer"))
    valid = is_query_kmer(F.col("kmer"), k)
    q = queries.withColumn("_q", F.when(valid, text))
    fwd, rev = order_key(F.col("_q")), reverse_order_key(F.col("_q"))
    q = q.withColumn("_own", fwd < rev).withColumn("_key", F.when(F.col("_q").isNotNull(), key_of_order(F.least(fwd, rev), k)))
    return _answers(q, queries.columns, index, k, canonical_mode)


def lookup_windows(seqs: DataFrame, index: DataFrame, k: int, canonical_mode: bool = False) -> DataFrame:
    """``lookup`` of every window of sequences (``seq``): their columns, ``pos, kmer, valid`` and the answer.

    Keys of both strands are made chunk by chunk, not anew for each k-mer.
    """
    q = query_windows(seqs, k)
    return _answers(q, [c for c in q.columns if c not in ("_key", "_own")], index, k, canonical_mode)


def _answers(q: DataFrame, names: list[str], index: DataFrame, k: int, canonical_mode: bool) -> DataFrame:
    """The columns ``names`` of ``q`` (with ``_key`` and ``_own``) and where each k-mer is."""
    joined = q.join(not_broadcast(index), same_key(F.col("_key"), k), "left")
    same = F.when(F.col("_own"), F.col("fwd")).otherwise(F.col("rev"))
    other = F.when(F.col("_own"), F.col("rev")).otherwise(F.col("fwd"))
    if canonical_mode:
        forward = same.isNotNull() & (other.isNull() | (same["kmer_offset"] <= other["kmer_offset"]))
    else:
        forward = same.isNotNull()
    hit = F.when(forward, same).otherwise(other)
    offset, sid = F.col("_hit.kmer_offset"), F.col("_hit.string_id")
    return joined.withColumn("_hit", hit).withColumn("_dir", F.when(forward, F.lit(1)).otherwise(F.lit(-1))).select(
        *names,
        offset.isNotNull().alias("found"), (offset - sid * (k - 1)).alias("kmer_id"), (offset - F.col("_hit.string_begin")).alias("kmer_id_in_string"), offset.alias("kmer_offset"),
        F.when(offset.isNotNull(), F.col("_dir")).cast("int").alias("orientation"), sid.alias("string_id"), F.col("_hit.string_begin").alias("string_begin"), F.col("_hit.string_end").alias("string_end"),
    )


#: Windows of strings, and asked ones, up to which a minimizer is light: one task meets them, a batch at a time.
KNOWN_WINDOWS, ASKED_WINDOWS = 1 << 16, 1 << 18


def known_runs(strings: DataFrame, k: int) -> DataFrame:
    """The runs of windows of a string set, for ``lookup_runs``: written once, for all its queries."""
    own = strings.select(F.col("string_id").alias("_sid"), F.col("string_begin").alias("_begin"), F.col("string_end").alias("_end"), "seq")
    return staged(window_runs(own, k, ["_sid", "_begin", "_end"], folded=True), "known-runs")


def _meet_windows(k: int, keep: list[str], canonical_mode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers every window of asked runs by the windows of the known runs with the same minimizer, which come before them.

    As in ``_meet``, windows meet by sorting their keys, and known runs of a batch's last minimizer are all that the next batch needs.
    """
    none = np.iinfo(np.int64).max

    def answers(batch: pa.RecordBatch, asked: np.ndarray, minimizer: np.ndarray) -> pa.RecordBatch:
        begin, at, piece = batch.column("_begin").fill_null(0).to_numpy(), batch.column("_at").to_numpy(), unfold(batch.column("_piece"))
        row, place, limbs, own = piece_windows(piece, k)
        order = np.argsort(limbs[0]) if len(limbs) == 1 else np.lexsort(limbs)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in limbs], axis=0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        offset, known, starts = (begin + at)[row] + place, ~asked[row], np.flatnonzero(new)
        wanted = np.flatnonzero(~known)
        group, own_wanted = group[wanted], own[wanted]
        first, turned_first = (np.minimum.reduceat(np.where(known & (own == side), offset, none)[order], starts)[group] for side in (True, False))
        same, turned = np.where(own_wanted, first, turned_first), np.where(own_wanted, turned_first, first)
        forward = (same < none) & ((same <= turned) | (not canonical_mode))
        row, place = row[wanted], place[wanted]
        found, valid = np.where(forward, same, turned), minimizer[row] >= 0
        miss = ~valid | (found == none)
        gone = miss if miss.any() else None
        # Strings do not overlap: the last one that begins up to a place holds it.
        held = np.flatnonzero(~asked)
        held = held[np.argsort(begin[held])]
        string = held[np.searchsorted(begin[held], np.where(miss, begin[held[0]], found), "right") - 1] if len(held) else np.zeros(len(row), np.int64)
        sid, end = (batch.column(c).fill_null(0).to_numpy()[string] for c in ("_sid", "_end"))
        turn = pa.array(np.where(miss, 0, np.where(forward, 1, -1)), pa.int32(), mask=None if valid.all() else ~valid)
        longs = [pa.array(x, mask=gone) for x in (found, sid, begin[string], end)]
        columns = [*(batch.column(c).take(pa.array(row)) for c in keep), pa.array(at[row] + place, pa.int32()), piece_kmers(piece, row, place, k), turn, *longs]
        return pa.RecordBatch.from_arrays(columns, [*keep, *MET])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            asked, minimizer = np.asarray(batch.column("_asked").to_numpy(zero_copy_only=False)), batch.column("_minimizer").to_numpy()
            held = batch.take(pa.array(np.flatnonzero(~asked & (minimizer == minimizer[-1]))))
            if asked.any():
                yield answers(batch, asked, minimizer)

    return run


#: What ``_meet_windows`` tells of each window, ``_turn`` being the orientation, 0 if it is nowhere and null if it is not valid: no more
#: than the rest can be made of, since a column costs more on its way from Python than a sum behind it.
MET = {"pos": IntegerType(), "kmer": StringType(), "_turn": IntegerType(), "kmer_offset": LongType(), "string_id": LongType(), "string_begin": LongType(), "string_end": LongType()}


def met_columns(met: DataFrame, keep: list[str], k: int) -> DataFrame:
    """The kept columns and the answer of every window, of what ``MET`` tells."""
    offset, sid, hit = F.col("kmer_offset"), F.col("string_id"), F.col("_turn") != 0
    return met.select(
        *keep, "pos", "kmer", F.col("_turn").isNotNull().alias("valid"),
        offset.isNotNull().alias("found"), (offset - sid * (k - 1)).alias("kmer_id"), (offset - F.col("string_begin")).alias("kmer_id_in_string"), "kmer_offset",
        F.when(hit, F.col("_turn")).alias("orientation"), "string_id", "string_begin", "string_end",
    )


def lookup_runs(seqs: DataFrame, known: DataFrame, k: int, canonical_mode: bool = False, limits: tuple[int, int] = (KNOWN_WINDOWS, ASKED_WINDOWS)) -> DataFrame:
    """``lookup_windows`` in a string set (its ``known_runs``) of which no index is stored.

    Neighbouring windows are shuffled as one row: runs of both sides are dealt by a minimizer that equal k-mers share, and
    their k-mers meet in that task.  Minimizers of more windows than ``limits``, known or asked, are counted first and
    re-keyed by k-mer, so none of them is a hot group.
    """
    keep = [c for c in seqs.columns if c != "seq"]
    return meet_runs(staged(window_runs(seqs, k, keep, folded=True), "asked-runs"), known, k, keep, canonical_mode, limits)


def meet_runs(mine: DataFrame, known: DataFrame, k: int, keep: list[str], canonical_mode: bool = False, limits: tuple[int, int] = (KNOWN_WINDOWS, ASKED_WINDOWS)) -> DataFrame:
    """As ``lookup_runs``, of written runs of asked windows."""
    sizes = known.select("_minimizer", F.col("_size").alias("_k"), F.lit(0).alias("_a")).unionAll(mine.filter("_minimizer >= 0").select("_minimizer", F.lit(0), "_size"))
    heavy = staged(sizes.groupBy("_minimizer").agg(F.sum("_k").alias("_k"), F.sum("_a").alias("_a")).filter((F.col("_k") > limits[0]) | (F.col("_a") > limits[1])).select("_minimizer"), "heavy")
    split = not heavy.isEmpty()

    def parted(light: bool) -> tuple[DataFrame, DataFrame]:
        return tuple(df.join(heavy, "_minimizer", "left_anti" if light else "left_semi") if split else df for df in (known, mine))

    own, asked = parted(True)
    place = ["_sid", "_begin", "_end"]
    both = own.select("_minimizer", F.lit(False).alias("_asked"), *place, "_at", "_piece").unionByName(asked.select("_minimizer", F.lit(True).alias("_asked"), "_at", "_piece", *keep), allowMissingColumns=True)
    schema = StructType([*(mine.schema[c] for c in keep), *(StructField(c, kind) for c, kind in MET.items())])
    order = F.col("_minimizer") * 2 + F.col("_asked").cast("bigint")  # one long, known runs first
    met = spread(both, "_minimizer").sortWithinPartitions(order).mapInArrow(_meet_windows(k, keep, canonical_mode), schema)
    found = met_columns(met, keep, k)
    if not split:
        return found
    own, asked = parted(False)
    offset = (F.col("_begin") + F.col("_at") + F.col("pos")).cast("bigint").alias("kmer_offset")
    rows = keyed_pieces(own.withColumnRenamed("_piece", "seq"), k, [*place, "_at"])
    index = _first_places(rows.select("key", "own", offset, *(F.col(c).alias(name) for c, name in zip(place, ("string_id", "string_begin", "string_end")))), k)
    q = query_pieces(asked.withColumnRenamed("_piece", "seq"), k, [*keep, "_at"]).withColumn("pos", F.col("_at") + F.col("pos"))
    return found.unionByName(_answers(q, [*keep, "pos", "kmer", "valid"], index, k, canonical_mode))


def query_key(kmer: Column, k: int) -> Column:
    """The join key of a k-mer's canonical form; null if it has another length or other letters."""
    text = F.upper(kmer)
    return F.when(is_query_kmer(kmer, k), key_of_order(F.least(order_key(text), reverse_order_key(text)), k))


def members(queries: DataFrame, index: DataFrame, k: int, absent: bool = False) -> DataFrame:
    """The rows of ``queries`` whose k-mer is in the dictionary on either strand, or, if ``absent``, is not."""
    q = queries.withColumn("_key", query_key(F.col("kmer"), k))
    return q.join(not_broadcast(index.select(*key_columns(k))), same_key(F.col("_key"), k), "left_anti" if absent else "left_semi").drop("_key")


#: k-mers that one task of a set operation holds at most, if none is frequent.
KEYS_A_TASK = 1 << 22


def canonical_keys(k: int, *sets: DataFrame) -> tuple[list[DataFrame], int]:
    """``key``: the canonical k-mers of each string set as join keys, for set operations between dictionaries; and the number of
    tasks to deal them over, in proportion to the letters, which are counted first: so the memory of a task doesn't grow with the sets."""
    bases = [s.agg(F.sum(F.col("string_end") - F.col("string_begin"))).first()[0] or 0 for s in sets]
    least = int(sets[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [window_keys(s.select("seq"), k, max(least, -(-n // KEYS_A_TASK))) for s, n in zip(sets, bases)], max(least, -(-sum(bases) // KEYS_A_TASK))


def kmer_union(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``kmer`` of either string set, on either strand.  Longs are shuffled, once; letters are made at the end."""
    (first, second), tasks = canonical_keys(k, a, b)
    return first.union(second).repartition(tasks, "key").distinct().select(kmer_of_key(F.col("key"), k).alias("kmer"))


def _both_keys(a: DataFrame, b: DataFrame, k: int, how: str) -> DataFrame:
    found, tasks = canonical_keys(k, a, b)
    first, second = (keys.repartition(tasks, "key").distinct() for keys in found)
    return first.join(not_broadcast(second), "key", how).select(kmer_of_key(F.col("key"), k).alias("kmer"))


def kmer_intersect(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``kmer`` of both string sets, on either strand."""
    return _both_keys(a, b, k, "left_semi")


def kmer_except(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``kmer`` of the first string set that the second does not hold on either strand."""
    return _both_keys(a, b, k, "left_anti")


def missing_windows(strings: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``kmer`` of every window of strings of ACGT that the index does not hold on either strand, as it stands.

    Only keys meet; the letters of what is missing are made of its key at the end.
    """
    asked = keyed_windows(strings.select("seq"), k, []).select(F.col("key").alias("_key"), "own")
    gone = asked.join(not_broadcast(index.select(*key_columns(k))), same_key(F.col("_key"), k), "left_anti")
    kmer = kmer_of_key(F.col("_key"), k)
    return gone.select(F.when(F.col("own"), kmer).otherwise(reverse_complement(kmer)).alias("kmer"))


def minimizer_found(windows: DataFrame, tuples: DataFrame) -> DataFrame:
    """``windows`` (with ``minimizer``) and whether the dictionary holds that minimizer: exact membership."""
    known = tuples.select(F.col("minimizer").alias("_known")).distinct()
    joined = windows.join(not_broadcast(known), F.col("minimizer") == F.col("_known"), "left")
    return joined.withColumn("minimizer_found", F.col("_known").isNotNull()).drop("_known")


def minimizer_join(reads: DataFrame, strings: DataFrame, k: int, m: int, seed: int = 1) -> DataFrame:
    """Forward-strand lookup that ships super-k-mers instead of k-mers: the same offsets as ``lookup`` on that strand.

    Reads are cut at letters other than ACGT, so all their valid windows take part.

    Both sides are cut into super-k-mers, joined on the minimizer, and the shared k-mers are
    read off by aligning the minimizer's places; a join row stands for up to k - m + 1
    k-mers.  A minimizer with many places is split by Spark's skew join.
    """
    known = super_kmers(strings, k, m, seed=seed, piece=True)
    known = known.select(F.col("minimizer").alias("_m"), (F.col("pos_in_seq") - F.col("pos_in_kmer")).alias("_at"), F.col("pos_in_kmer").alias("_in"), F.col("num_kmers").alias("_n"), F.col("piece").alias("_theirs"))
    own = stretches(reads.select("query_id", "seq"), k)
    own = own.select(F.struct("query_id", "offset").alias("string_id"), F.lit(0).cast("bigint").alias("string_begin"), "seq")
    mine = super_kmers(own, k, m, seed=seed, piece=True).withColumnRenamed("piece", "_piece")
    joined = mine.join(not_broadcast(known), F.col("minimizer") == F.col("_m"))
    # Window i of mine meets window i + shift of theirs, where the minimizers lie on each other.
    shift = F.col("_in") - F.col("pos_in_kmer")
    first, last = F.greatest(F.lit(0), -shift), F.least(F.col("num_kmers"), F.col("_n") - shift)
    rows = joined.withColumn("_shift", shift).withColumn("_first", first).withColumn("_last", last).filter("_first < _last")
    rows = rows.withColumn("i", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)))
    same = F.substring("_piece", F.col("i") + 1, F.lit(k)) == F.substring("_theirs", F.col("i") + F.col("_shift") + 1, F.lit(k))
    hits = rows.filter(same).groupBy(F.col("string_id.query_id").alias("query_id"), (F.col("string_id.offset") + F.col("first_pos") + F.col("i")).cast("int").alias("pos"))
    return hits.agg(F.min(F.col("_at") + F.col("i") + F.col("_shift")).cast("bigint").alias("kmer_offset"))


#: Places of a minimizer, and runs of reads on it, up to which it is light: work is linear in both, so the bounds only keep tasks even.
PLACES_LIMIT, ASKED_LIMIT = 1 << 12, 1 << 14


def _meet(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers the windows of asked runs by those of the known runs with the same minimizer.

    Rows (``minimizer, asked, query_id, at, piece``) come by minimizer, its known runs first, so known runs of a batch's
    last minimizer are all that the next batch needs.  Windows meet by sorting their keys: the work is
    linear in the runs but for the sort, however many runs share a minimizer.
    """
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            asked, minimizer = np.asarray(batch.column("asked").to_numpy(zero_copy_only=False)), batch.column("minimizer").to_numpy()
            held = batch.take(pa.array(np.flatnonzero(~asked & (minimizer == minimizer[-1]))))
            row, place, limbs, own = piece_windows(batch.column("piece"), k)
            if not asked.any() or not len(row):
                continue
            order = np.argsort(limbs[0]) if len(limbs) == 1 else np.lexsort(limbs)
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in limbs], axis=0)
            row, own, at = row[order], own[order], (batch.column("at").to_numpy()[row] + place)[order]
            group, starts, known = np.cumsum(new) - 1, np.flatnonzero(new), ~asked[row]
            first, turned_first = (np.minimum.reduceat(np.where(known & (own == side), at, none), starts)[group] for side in (True, False))
            same, turned = np.where(own, first, turned_first), np.where(own, turned_first, first)
            hit = np.flatnonzero(~known & ((same < none) | (turned < none)))
            same, turned = same[hit], turned[hit]
            columns = [batch.column("query_id").take(pa.array(row[hit])), pa.array(at[hit]), pa.array(same, mask=same == none), pa.array(turned, mask=turned == none)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "pos", "_same", "_turned"])

    return run


def minimizer_lookup(reads: DataFrame, strings: DataFrame, k: int, m: int, seed: int = 1, canonical_mode: bool = True, light: int = PLACES_LIMIT) -> DataFrame:
    """``query_id, pos, kmer_offset, orientation`` of every window of the reads that is stored on either strand: as ``lookup`` gives it,
    by canonical super-k-mers.

    Minimizers of at most ``light`` places ship runs of k-mers: both sides' super-k-mers are dealt by the
    minimizer, and the k-mers of its runs meet in that task, by their canonical form.  Minimizers of more places (or of more
    than ``ASKED_LIMIT`` runs of reads) are re-keyed by k-mer in the same plan, so none of them is a hot group, and so are windows whose
    two strands' minimizers have one value, since their place depends on the strand.  A k-mer's places all take the same way.
    """
    known = staged(super_kmers(strings, k, m, True, seed, piece=True, ties=True), "known-runs")
    pieces = stretches(reads.select("query_id", "seq"), k)
    pieces = pieces.select(F.struct("query_id", "offset").alias("string_id"), F.lit(0).cast("bigint").alias("string_begin"), "seq")
    mine = staged(super_kmers(pieces, k, m, True, seed, piece=True, ties=True), "asked-runs")
    runs = known.select("minimizer", F.lit(0).alias("_a")).unionByName(mine.select("minimizer", F.lit(1).alias("_a")))
    places, asked = F.count_if(F.col("_a") == 0), F.count_if(F.col("_a") == 1)
    counts = staged(runs.groupBy("minimizer").agg(places.alias("_places"), asked.alias("_asked")).filter((places > light) | (asked > ASKED_LIMIT)).select(F.col("minimizer").alias("_heavy")), "heavy")

    def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        tagged = df.join(counts, F.col("minimizer") == F.col("_heavy"), "left").withColumn("_keyed", F.col("tie") | F.col("_heavy").isNotNull())
        return tagged.filter(~F.col("_keyed")), tagged.filter("_keyed")

    known_runs = known.select("minimizer", "tie", F.lit(False).alias("asked"), (F.col("pos_in_seq") - F.col("pos_in_kmer")).alias("at"), "piece")
    place = (F.col("string_id.offset") + F.col("first_pos")).cast("bigint").alias("at")
    asked_runs = mine.select("minimizer", "tie", F.lit(True).alias("asked"), F.col("string_id.query_id").alias("query_id"), place, "piece")
    (known_light, known_keyed), (asked_light, asked_keyed) = parted(known_runs), parted(asked_runs)

    # Keyed by k-mer: the first place of either strand, by minima that combine before the shuffle.
    places = keyed_pieces(known_keyed.select("at", F.col("piece").alias("seq")), k, ["at"]).withColumn("_off", F.col("at") + F.col("pos"))
    firsts = places.groupBy(F.col("key").alias("_k")).agg(*[F.min(F.when(F.col("own") == own, F.col("_off"))).alias(c) for c, own in (("_f", True), ("_r", False))])
    wanted = keyed_pieces(asked_keyed.select("query_id", "at", F.col("piece").alias("seq")), k, ["query_id", "at"])
    by_key = wanted.join(not_broadcast(firsts), F.col("key") == F.col("_k")).select("query_id", (F.col("at") + F.col("pos")).alias("pos"), F.when(F.col("own"), F.col("_f")).otherwise(F.col("_r")).alias("_same"), F.when(F.col("own"), F.col("_r")).otherwise(F.col("_f")).alias("_turned"))

    # Dealt as runs: those of one minimizer meet in one task.
    names = ["minimizer", "asked", "query_id", "at", "piece"]
    both = known_light.unionByName(asked_light, allowMissingColumns=True).select(*names).repartition("minimizer").sortWithinPartitions("minimizer", "asked")
    kind = reads.schema["query_id"].dataType.simpleString()
    best = both.mapInArrow(_meet(k), f"query_id {kind}, pos long, _same long, _turned long").unionByName(by_key)
    forward = F.col("_same").isNotNull() & ((F.col("_turned").isNull() | (F.col("_same") <= F.col("_turned"))) if canonical_mode else F.lit(True))
    return best.select("query_id", F.col("pos").cast("int").alias("pos"), F.when(forward, F.col("_same")).otherwise(F.col("_turned")).cast("bigint").alias("kmer_offset"), F.when(forward, 1).otherwise(-1).alias("orientation"))
