"""Whole-sequence scans: every window looked up, with search and extension counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.lookups import lookup, lookup_windows
from strandloom.staging import not_broadcast


def scan_lookup(reads: DataFrame, index: DataFrame, k: int, canonical_mode: bool = False) -> DataFrame:
    """One row per window of every read (``query_id, seq``): the lookup of its k-mer, and ``valid``.

    Stateless, so it serves batch and stream alike.
    """
    return lookup_windows(reads, index, k, canonical_mode)


def with_extension(scan: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds ``is_extension``: the window continues its predecessor's hit by one base in its direction.

    Well defined if every k-mer has one place (a spectrum-preserving string set).  A read is dealt
    in blocks of so many windows, each with the last window before it, so no task holds a long one.
    """
    own = F.floor(F.col("pos") / block)
    dealt = scan.withColumn("_block", F.explode(F.when(F.pmod(F.col("pos"), F.lit(block)) == block - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    before = Window.partitionBy("query_id", "_block").orderBy("pos")
    prev = lambda c: F.lag(c).over(before)
    follows = (
        F.col("found") & prev("found") & (prev("pos") == F.col("pos") - 1) & (prev("string_id") == F.col("string_id"))
        & (prev("orientation") == F.col("orientation")) & (F.col("kmer_offset") == prev("kmer_offset") + F.col("orientation"))
    )
    return dealt.withColumn("is_extension", F.coalesce(follows, F.lit(False))).filter(F.col("_block") == own).drop("_block")


def scan_stats(scan: DataFrame) -> DataFrame:
    """One row: windows, found, not_found, hit_rate, searches, extensions, invalid, negative.

    Invalid windows count as not found; valid = searches + extensions + negative.
    """
    flagged = with_extension(scan)
    total = F.count(F.lit(1))
    found = F.count_if(F.col("found"))
    return flagged.agg(
        total.alias("windows"), found.alias("found"), (total - found).alias("not_found"),
        F.when(total > 0, F.round(found * 100.0 / total, 6)).alias("hit_rate"),
        F.count_if(F.col("found") & ~F.col("is_extension")).alias("searches"), F.count_if("is_extension").alias("extensions"),
        F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & ~F.col("found")).alias("negative"),
    )


def scan_check(scan: DataFrame, index: DataFrame, k: int, canonical_mode: bool = False) -> DataFrame:
    """``windows, mismatches``: the scan against direct lookups of the distinct k-mers, nulls being equal."""
    fields = ["kmer_id", "kmer_id_in_string", "orientation", "string_id", "string_begin", "string_end"]
    direct = lookup(scan.select("kmer").distinct(), index, k, canonical_mode)
    direct = direct.select(F.col("kmer").alias("_kmer"), F.struct(*fields).alias("_direct"))
    joined = scan.join(not_broadcast(direct), F.col("kmer") == F.col("_kmer"))
    differ = ~F.struct(*fields).eqNullSafe(F.col("_direct"))
    return joined.agg(F.count(F.lit(1)).alias("windows"), F.count_if(differ).alias("mismatches"))
