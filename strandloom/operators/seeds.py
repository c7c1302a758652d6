"""Scans of input with repeats: search, then follow the string that was found as long as the read agrees with it.

A k-mer with several places is answered by its first one, but a scan that has found a string stays
on it.  So what a window is answered depends on all windows before it, back to the last search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import reverse_complement
from strandloom.operators.windows import CHUNK, _held, chunks
from strandloom.staging import staged

#: Windows of one block of a read.
BLOCK = 1 << 16
#: Letters of a read and a string that are compared in one row, and most such rows of a segment in one round.
PIECE, MOST_PIECES = 256, 64


def segments(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stretches of neighbouring windows whose first places lie on one diagonal: ``query_id, _block, a, b`` (first and
    last window), ``off`` (place of window a), ``orientation, string_id, string_begin, string_end``, and whether
    the window after b is known to be nowhere (``_alone``).

    Blocks of a read are cut apart, so no task holds a long one.
    """
    hits = found.filter("found").withColumn("_block", F.floor(F.col("pos") / block))
    own = Window.partitionBy("query_id", "_block").orderBy("pos")
    prev = lambda c: F.lag(c).over(own)
    follows = (prev("pos") == F.col("pos") - 1) & (prev("string_id") == F.col("string_id")) & (prev("orientation") == F.col("orientation")) & (prev("kmer_offset") + F.col("orientation") == F.col("kmer_offset"))
    marked = hits.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_seg", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.groupBy("query_id", "_block", "_seg").agg(
        F.min("pos").cast("long").alias("a"), F.max("pos").cast("long").alias("b"), F.min_by("kmer_offset", "pos").alias("off"), F.min("orientation").cast("long").alias("orientation"),
        *[F.min(c).alias(c) for c in ("string_id", "string_begin", "string_end")],
    )
    after = F.lead("a").over(Window.partitionBy("query_id", "_block").orderBy("a"))
    inside = F.col("b") + 1 < (F.col("_block") + 1) * block
    return rows.withColumn("_alone", inside & ~F.coalesce(after == F.col("b") + 1, F.lit(False))).drop("_seg")


def _same_letters(x: Column, y: Column, n: Column) -> Column:
    """How many letters two strings share at their begin, of ``n`` (below 2 * PIECE); none if there is no string.

    The longest common prefix is found by halves: nine comparisons, not one a letter.
    """
    halves = F.array(*[F.lit(PIECE >> e) for e in range(PIECE.bit_length())])
    longer = lambda have, step: F.when((have + step <= n) & (F.substring(x, F.lit(1), have + step) == F.substring(y, F.lit(1), have + step)), have + step).otherwise(have)
    return F.when(x == y, n).otherwise(F.aggregate(halves, F.lit(0), longer)).cast("long")


def follow(rows: DataFrame, reads: DataFrame, strings: DataFrame, k: int) -> DataFrame:
    """Adds ``more``: by how many windows the read goes on to agree with the string after a segment, ``_limit`` at most.

    Letters are compared, not k-mers looked up: a piece of the read's chunk with a piece of the string's chunk.
    Rounds compare 1, 2, 4 and more pieces of a segment at once, and only segments that agree in all go on.
    """
    width = PIECE
    texts = chunks(reads.select("query_id", F.upper("seq").alias("seq")), k, ["query_id"], right=width).select(F.col("query_id").alias("_q"), F.col("_c").cast("long").alias("_qc"), F.col("_text").alias("_read"))
    held = chunks(strings.select("string_id", "seq"), k, ["string_id"], left=width, right=width).select(F.col("string_id").alias("_s"), F.col("_c").cast("long").alias("_sc"), F.col("_text").alias("_held"))
    texts, held = staged(texts, "read-chunks"), staged(held, "string-chunks")
    off_b = F.col("off") + F.col("orientation") * (F.col("b") - F.col("a"))
    live = rows.filter("_limit > 0").select("query_id", "a", (F.col("b") + 1).alias("_p"), (off_b + F.col("orientation") - F.col("string_begin")).alias("_place"), "orientation", "string_id", F.col("_limit").alias("_left"), F.lit(0).cast("long").alias("_more"))
    done, n = [], 1
    while True:
        pieces = live.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n), F.ceil(F.col("_left") / width)) - 1)))
        at, place = F.col("_p") + F.col("_j") * width, F.col("_place") + F.col("orientation") * F.col("_j") * width
        pieces = pieces.withColumn("_at", at).withColumn("_on", place).withColumn("_n", F.least(F.lit(width), F.col("_left") - F.col("_j") * width).cast("int"))
        met = pieces.join(texts, (F.col("query_id") == F.col("_q")) & (F.floor(F.col("_at") / CHUNK) == F.col("_qc")), "left")
        met = met.join(held, (F.col("string_id") == F.col("_s")) & (F.floor(F.col("_on") / CHUNK) == F.col("_sc")), "left")
        first = (F.when(F.col("_sc") > 0, width).otherwise(0) + F.pmod(F.col("_on"), F.lit(CHUNK))).cast("int")
        x = F.substring("_read", (F.pmod(F.col("_at"), F.lit(CHUNK)) + k).cast("int"), F.col("_n"))
        y = F.when(F.col("orientation") > 0, F.substring("_held", first + k, F.col("_n"))).otherwise(reverse_complement(F.substring("_held", first - F.col("_n") + 2, F.col("_n"))))
        met = _held(_held(met, "_x", x), "_y", y).withColumn("_same", F.coalesce(_same_letters(F.col("_x"), F.col("_y"), F.col("_n")), F.lit(0)))
        ends = met.groupBy("query_id", "a").agg(
            *[F.min(c).alias(c) for c in ("_p", "_place", "orientation", "string_id", "_left", "_more")],
            F.min(F.when(F.col("_same") < F.col("_n"), F.col("_j") * width + F.col("_same"))).alias("_stop"), F.max(F.col("_j") * width + F.col("_n")).alias("_seen"),
        )
        ends = staged(ends, "followed")
        over = F.col("_stop").isNotNull() | (F.col("_seen") >= F.col("_left"))
        done.append(ends.filter(over).select("query_id", "a", (F.col("_more") + F.coalesce("_stop", "_seen")).alias("_more")))
        seen = F.col("_seen")
        live = ends.filter(~over).select("query_id", "a", (F.col("_p") + seen).alias("_p"), (F.col("_place") + F.col("orientation") * seen).alias("_place"), "orientation", "string_id", (F.col("_left") - seen).alias("_left"), (F.col("_more") + seen).alias("_more"))
        if live.isEmpty():
            break
        n = min(2 * n, MOST_PIECES)
    more = done[0]
    for d in done[1:]:
        more = more.unionByName(d)
    more = more.select(F.col("query_id").alias("_q"), F.col("a").alias("_a"), "_more")
    return rows.join(more, (F.col("query_id") == F.col("_q")) & (F.col("a") == F.col("_a")), "left").withColumn("more", F.coalesce("_more", F.lit(0))).drop("_q", "_a", "_more")


def reaches(segs: DataFrame, reads: DataFrame, strings: DataFrame, k: int) -> DataFrame:
    """Segments with ``reach``: the last window up to which the read agrees with the string on the segment's diagonal.

    Letters are compared up to the next segment of the same diagonal; from there its own reach counts.
    """
    off_b = F.col("off") + F.col("orientation") * (F.col("b") - F.col("a"))
    room = F.when(F.col("orientation") > 0, F.col("string_end") - k - off_b).otherwise(off_b - F.col("string_begin"))
    along = Window.partitionBy("query_id", "string_id", "orientation", "_diagonal").orderBy("a")
    rows = segs.withColumn("_diagonal", F.col("off") - F.col("orientation") * F.col("a")).withColumn("_gap", F.lead("a").over(along) - F.col("b") - 1)
    rows = staged(rows.withColumn("_limit", F.when(F.col("_alone"), 0).otherwise(F.least(room, F.col("_gap")))), "segments")
    rows = follow(rows, reads, strings, k)
    rows = rows.withColumn("_linked", F.coalesce(F.col("more") >= F.col("_gap"), F.lit(False)))
    chain = F.sum(F.when(F.lag("_linked").over(along), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_chain", chain).withColumn("_end", F.col("b") + F.col("more"))
    return rows.withColumn("reach", F.max("_end").over(Window.partitionBy("query_id", "string_id", "orientation", "_diagonal", "_chain")))


def exits(last: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Where a scan that searches in each segment of a block goes on behind the block: its next search is there or later."""
    out = np.empty(len(last), np.int64)
    after = np.searchsorted(last, reach + 1)
    for i in range(len(last) - 1, -1, -1):
        out[i] = out[after[i]] if after[i] < len(last) else reach[i] + 1
    return out


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, up to which window a search leads to which exit."""
    for batch in batches:
        upto, to = [], []
        for segs in batch.column("segs"):
            last = np.array([s["b"] for s in segs.as_py()], np.int64)
            out = exits(last, np.array([s["reach"] for s in segs.as_py()], np.int64))
            keep = np.r_[out[1:] != out[:-1], True]
            upto.append(last[keep].tolist())
            to.append(out[keep].tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("_block"), pa.array(upto, kind), pa.array(to, kind)], ["query_id", "_block", "upto", "to"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of each read, with the first window (``entry``) at which a search may start in each."""
    read, p = None, 0
    for batch in batches:
        entry = []
        for own, upto, to in zip(*(batch.column(c).to_pylist() for c in ("query_id", "upto", "to"))):
            if own != read:
                read, p = own, 0
            entry.append(p)
            i = int(np.searchsorted(upto, p))
            p = to[i] if i < len(to) else p
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("_block"), pa.array(entry, pa.int64())], ["_q", "_b", "entry"])


def _searches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The searches of each block, with how far each is followed."""
    names = ("first_pos", "num_kmers", "kmer_offset", "orientation", "string_id")
    for batch in batches:
        reads, out = [], []
        for own, p, segs in zip(*(batch.column(c).to_pylist() for c in ("query_id", "entry", "segs"))):
            for s in segs:
                if s["b"] < p:
                    continue
                start = max(p, s["a"])
                p = s["reach"] + 1
                reads.append(own)
                out.append((start, p - start, s["off"] + s["orientation"] * (start - s["a"]), s["orientation"], s["string_id"]))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(reads, batch.schema.field("query_id").type), *(pa.array(c, pa.int64()) for c in columns)], ["query_id", *names])


def seeded_runs(found: DataFrame, reads: DataFrame, strings: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, first_pos, num_kmers, kmer_offset, orientation, string_id``: every search of a scan, and how many windows it answers.

    ``found`` is the lookup of every window of the ``reads`` (``query_id, seq``).  A scan searches at the first window
    that has a place, takes the first one, and follows its string in the orientation found, window by window, as
    long as the read's next base is the string's; then it searches again.  Counters are exact whether
    or not k-mers repeat: searches are rows, extensions ``num_kmers - 1``.

    The last window that a search reaches depends on its segment alone, so a block of windows is a map from the
    window at which the next search may start to that behind the block.  Blocks are worked out in parallel,
    composed read by read, one number each, and walked in parallel.  A null id is an id; reads are told
    apart by their ids alone.
    """
    return followed_runs(segments(found, block), reads, strings, k)


def followed_runs(segs: DataFrame, reads: DataFrame, strings: DataFrame, k: int) -> DataFrame:
    """As ``seeded_runs``, of the ``segments`` of a scan: those of a read are walked from its first window on."""
    hits = reaches(segs, reads, strings, k)
    fields = F.struct("a", "b", "reach", "off", "orientation", "string_id")
    blocks = staged(hits.groupBy("query_id", "_block").agg(F.array_sort(F.collect_list(fields)).alias("segs")), "scan-blocks")
    kind = blocks.schema["query_id"].dataType.simpleString()
    ways = blocks.mapInArrow(_ways, f"query_id {kind}, _block long, upto array<long>, to array<long>")
    entries = ways.repartition("query_id").sortWithinPartitions("query_id", "_block").mapInArrow(_entries, f"_q {kind}, _b long, entry long")
    met = blocks.join(entries, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("_block") == F.col("_b"))).select("query_id", "entry", "segs")
    return met.mapInArrow(_searches, f"query_id {kind}, first_pos long, num_kmers long, kmer_offset long, orientation long, string_id long")


def seeded_stats(found: DataFrame, runs: DataFrame) -> DataFrame:
    """One row, as ``scan_stats`` gives: the counters of a scan whose k-mers may repeat."""
    total, hits = F.count(F.lit(1)), F.count_if(F.col("found"))
    windows = found.agg(
        total.alias("windows"), hits.alias("found"), (total - hits).alias("not_found"), F.when(total > 0, F.round(hits * 100.0 / total, 6)).alias("hit_rate"),
        F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & ~F.col("found")).alias("negative"),
    )
    searched = runs.agg(F.count(F.lit(1)).alias("searches"), F.coalesce(F.sum(F.col("num_kmers") - 1), F.lit(0)).alias("extensions"))
    return windows.join(F.broadcast(searched)).select("windows", "found", "not_found", "hit_rate", "searches", "extensions", "invalid", "negative")
