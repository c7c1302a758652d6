"""Workloads that time one thing each, on a dictionary whose tables are held in memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import fixtures
from strandloom.config import BuildConfig
from strandloom.functions import reverse_complement
from strandloom.operators.windows import kmer_windows, spread
from strandloom.plans.dictionary import build_dictionary

ROWS = 1_000_000


def workloads(spark: SparkSession, sf_dir: str, k: int = 31, m: int = 13) -> dict[str, Callable[[], DataFrame]]:
    """Build, positive, negative and canonical lookups, locate, and a scan with counters: a plan for each."""
    seqs = spread(fixtures.seq_part(spark, sf_dir), "id").persist()
    d = build_dictionary(seqs, BuildConfig(k=k, m=m))
    canonical = build_dictionary(seqs, BuildConfig(k=k, m=m, canonical=True))
    held = [d.index.persist(), d.strings.persist(), canonical.index.persist()]
    for df in held:
        df.count()
    own = spread(kmer_windows(seqs, k).select("kmer").limit(ROWS), "kmer").persist()  # a limit leaves one partition
    absent = spark.range(ROWS).select(F.substring(F.translate(F.md5(F.concat(F.lit("q"), F.col("id").cast("string")).cast("binary")), fixtures.HEX, fixtures.BASES), 1, k).alias("kmer")).persist()
    turned = own.select(F.when(F.xxhash64("kmer") % 2 == 0, reverse_complement(F.col("kmer"))).otherwise(F.col("kmer")).alias("kmer")).persist()
    bases = d.strings.agg(F.max("string_end")).first()[0]
    places = spark.range(ROWS).select(F.pmod(F.xxhash64("id"), F.lit(bases)).alias("pos")).persist()
    for df in (own, absent, turned, places):
        df.count()
    reads = fixtures.reads(spark, sf_dir)
    return {
        # Another id column, so that the plan is not taken from the tables in memory.
        "build": lambda: build_dictionary(seqs.withColumn("id", F.col("id") + 1), BuildConfig(k=k, m=m)).index,
        "positive_lookup": lambda: d.query(own),
        "negative_lookup": lambda: d.query(absent),
        "canonical_lookup": lambda: canonical.query(turned),
        "locate": lambda: d.locate(places),
        "scan_with_counters": lambda: d.stats(reads),
    }
