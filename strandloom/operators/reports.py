"""Reports on dictionaries and queries, each a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import ceil_log2, is_query_kmer

#: Bits that a minimal perfect hash function is taken to need per key.
MPHF_BITS = 4


def point_report(found: DataFrame) -> DataFrame:
    """``found, not_found, total, hit_rate`` of a lookup; rows of a wrong length count in the total."""
    total, hits = F.count(F.lit(1)), F.count_if(F.col("found"))
    return found.agg(hits.alias("found"), (total - hits).alias("not_found"), total.alias("total"), F.when(total > 0, F.round(hits * 100.0 / total, 6)).alias("hit_rate"))


def query_validity(queries: DataFrame, k: int) -> DataFrame:
    length = F.length("kmer") == k
    return queries.select(*queries.columns, F.coalesce(length, F.lit(False)).alias("right_length"), is_query_kmer(F.col("kmer"), k).alias("valid"))


def dictionary_totals(strings: DataFrame, tuples: DataFrame, k: int, m: int, canonical: bool) -> DataFrame:
    """One row: strings, bases, k-mers, minimizers, k, m, mode."""
    s = strings.agg(F.count(F.lit(1)).alias("num_strings"), F.coalesce(F.sum(F.col("string_end") - F.col("string_begin")), F.lit(0)).cast("bigint").alias("total_bases"))
    t = tuples.select("minimizer").distinct().agg(F.count(F.lit(1)).alias("num_minimizers"))
    kmers = (F.col("total_bases") - F.col("num_strings") * (k - 1)).alias("num_kmers")
    # Two tables of one row each.
    return s.withColumn("_one", F.lit(1)).join(t.withColumn("_one", F.lit(1)), "_one").select("num_strings", "total_bases", kmers, "num_minimizers", F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(canonical).alias("canonical"))


def string_lengths(strings: DataFrame) -> DataFrame:
    length = F.col("string_end") - F.col("string_begin")
    return strings.groupBy(length.alias("string_length")).agg(F.count(F.lit(1)).alias("num_strings"))


def space_model(totals: DataFrame, stats: DataFrame) -> DataFrame:
    """Bits by part of a succinct index of these counts, and bits per k-mer: a model, not a file size."""
    one = F.lit(1)
    t = totals.withColumn("_one", one).join(stats.select(F.col("num_positions"), F.col("num_kmers_in_heavy")).withColumn("_one", one), "_one")
    strings = F.col("total_bases") * 2
    width = ceil_log2(F.col("total_bases")).cast("bigint")
    ends = F.col("num_strings") * (2 + ceil_log2(F.floor(F.col("total_bases") / F.greatest(F.col("num_strings"), one)))).cast("bigint")
    t = t.select(
        "num_kmers", strings.cast("bigint").alias("strings_bits"), ends.cast("bigint").alias("string_offsets_bits"), (F.col("num_positions") * width).cast("bigint").alias("offsets_bits"),
        (F.col("num_minimizers") * MPHF_BITS).cast("bigint").alias("mphf_bits"), (F.col("num_kmers_in_heavy") * MPHF_BITS).cast("bigint").alias("skew_mphf_bits"),
    )
    total = F.col("strings_bits") + F.col("string_offsets_bits") + F.col("offsets_bits") + F.col("mphf_bits") + F.col("skew_mphf_bits")
    return t.withColumn("total_bits", total).withColumn("bits_per_kmer", F.when(F.col("num_kmers") > 0, F.round(total / F.col("num_kmers"), 6)))


def build_estimate(totals: DataFrame, ram_gib: int = 8, bytes_per_kmer: int = 48) -> DataFrame:
    """Bytes that an in-memory build is taken to need, and whether that passes the limit (0: none)."""
    need = F.col("num_kmers") * bytes_per_kmer
    return totals.select("num_kmers", need.cast("bigint").alias("estimated_bytes"), (F.lit(ram_gib > 0) & (need > ram_gib * (1 << 30))).alias("needs_external_sort"))


def self_check(found: DataFrame, first: int = 10) -> DataFrame:
    """The first missing k-mers, in order, of a lookup of the dictionary's own input: none if all is well."""
    return first_missing(found.filter(~F.col("found")), first)


def first_missing(missing: DataFrame, first: int = 10) -> DataFrame:
    return missing.select("kmer").orderBy("kmer").limit(first)


def check_totals(found: DataFrame) -> DataFrame:
    """``windows, missing``: one row."""
    return found.agg(F.count(F.lit(1)).alias("windows"), F.count_if(~F.col("found")).alias("missing"))
