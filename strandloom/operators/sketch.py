"""A sketch of the keys of an index: most absent k-mers are told before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.lookups import key_columns, meet_runs, query_key, same_key
from strandloom.operators.windows import query_pieces, window_runs
from strandloom.staging import DROP_SHUFFLES, held_conf, not_broadcast, staged

#: Bits of one block (32 KB); all bits of a key lie in one.
BLOCK_BITS = 1 << 18
BITS_PER_KEY, HASHES = 12, 6
#: Most bytes of a sketch that is sent to every executor.
MOST_BYTES = 64 << 20

U = np.uint64


def bits_of(h: np.ndarray) -> np.ndarray:
    """The places of the bits of hashed keys in their blocks, one row a hash."""
    x = h.view(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    first, step = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
    return ((first + np.arange(HASHES, dtype=U)[:, None] * step) % U(BLOCK_BITS)).astype(np.int64)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each with the bits of its keys."""

    def row(block: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], ["block", "bits"])

    at, held = None, None
    for batch in batches:
        block, h = batch.column("block").to_numpy(), batch.column("h").to_numpy()
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for lo, hi in zip(starts, [*starts[1:], len(block)]):
            if block[lo] != at:
                if held is not None:
                    yield row(at, held)
                at, held = int(block[lo]), np.zeros(BLOCK_BITS, bool)
            held[bits_of(h[lo:hi]).ravel()] = True
    if held is not None:
        yield row(at, held)


@dataclass(frozen=True)
class Sketch:
    """A Bloom filter in blocks: never says no to a key that is held."""

    blocks: int
    bits: Broadcast

    def maybe(self, h: Column) -> Column:
        """Whether hashed keys may be held."""
        blocks, bits = self.blocks, self.bits

        @F.pandas_udf("boolean")
        def ask(h: pd.Series) -> pd.Series:
            x = h.to_numpy(np.int64)
            place = (x % blocks) * BLOCK_BITS + bits_of(x)  # one row a hash
            held = bits.value[place >> 3] & (np.uint8(128) >> (place & 7).astype(np.uint8))
            return pd.Series((held != 0).all(axis=0))

        return ask(h)


def sketch_keys(index: DataFrame, k: int, most_bytes: int = MOST_BYTES) -> Sketch | None:
    """The sketch of an index's keys, or None if it would be larger than ``most_bytes``: keys are counted before any is sent.

    Keys are dealt by block, so each block is filled by one task, and only the filled blocks come together.
    """
    blocks = _blocks(index.count())
    if blocks * BLOCK_BITS // 8 > most_bytes:
        return None
    return _sketched(index, F.xxhash64(*key_columns(k)), blocks)


def _blocks(count: int) -> int:
    return max(1, -(-count * BITS_PER_KEY // BLOCK_BITS))


def _sketched(rows: DataFrame, h: Column, blocks: int) -> Sketch:
    """The sketch of hashes."""
    rows = rows.select(F.pmod(h, F.lit(blocks)).cast("long").alias("block"), h.alias("h"))
    with held_conf(rows.sparkSession, **DROP_SHUFFLES):
        filled = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_filled, "block long, bits binary").collect()
    bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for r in filled:
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return Sketch(blocks, rows.sparkSession.sparkContext.broadcast(bits.ravel()))


def members_sketched(queries: DataFrame, index: DataFrame, k: int, sketch: Sketch | None, absent: bool = False) -> DataFrame:
    """As ``lookups.members``: the rows whose k-mer is held, or, if ``absent``, is not.

    Rows that the sketch rules out are never shuffled; the others are decided by the exact join, as all are
    without a sketch.
    """
    q = queries.withColumn("_key", query_key(F.col("kmer"), k))
    kind = "left_anti" if absent else "left_semi"
    held = not_broadcast(index.select(*key_columns(k)))
    if sketch is None:
        return q.join(held, same_key(F.col("_key"), k), kind).drop("_key")
    parts = [F.col("_key")] if key_columns(k) == ["key"] else [F.col(f"_key.{c}") for c in key_columns(k)]
    q = q.withColumn("_maybe", F.col("_key").isNotNull() & sketch.maybe(F.xxhash64(*parts)))
    asked = q.filter("_maybe").join(held, same_key(F.col("_key"), k), kind)
    return (asked.unionByName(q.filter("NOT _maybe")) if absent else asked).drop("_key", "_maybe")


def windows_sketched(seqs: DataFrame, known: DataFrame, k: int, absent: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of sequences, ``pos`` and ``kmer`` of every window that is held, or, if ``absent``, is not, by the
    ``known_runs`` of a string set.

    The minimizers of its runs are sketched: a run whose minimizer is not held is told where it is and never shuffled, all others
    meet the known runs, run by run.  A sketch of more minimizers than its bytes serve rules out less and errs never.
    """
    keep = [c for c in seqs.columns if c != "seq"]
    h = F.xxhash64("_minimizer")
    sketch = _sketched(known, h, min(_blocks(known.count()), max(1, most_bytes * 8 // BLOCK_BITS)))
    asked = window_runs(seqs, k, keep, folded=True).withColumn("_maybe", (F.col("_minimizer") >= 0) & sketch.maybe(h))
    met = meet_runs(staged(asked.filter("_maybe").drop("_maybe"), "asked-runs"), known, k, keep)
    found = met.filter("NOT found" if absent else "found").select(*keep, "pos", "kmer")
    if not absent:
        return found
    gone = query_pieces(asked.filter("NOT _maybe").withColumnRenamed("_piece", "seq"), k, [*keep, "_at"], {"kmer": "kmer"})
    return found.unionByName(gone.select(*keep, (F.col("_at") + F.col("pos")).alias("pos"), "kmer"))
