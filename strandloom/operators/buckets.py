"""Buckets of super-k-mers that share a minimizer, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import LIGHT_LIMIT
from strandloom.functions import ceil_log2
from strandloom.staging import not_broadcast


def bucket_class(size: Column) -> Column:
    return F.when(size == 1, "singleton").when(size <= LIGHT_LIMIT, "light").otherwise("heavy")


def buckets(tuples: DataFrame) -> DataFrame:
    """``minimizer, bucket_size`` (distinct places), ``num_tuples, num_kmers, bucket_class``.

    Distinct places are counted over rows already summed by (minimizer, place), so a heavy
    minimizer is spread before it meets.
    """
    places = tuples.groupBy("minimizer", "pos_in_seq").agg(F.count(F.lit(1)).alias("_t"), F.sum("num_kmers").alias("_k"))
    out = places.groupBy("minimizer").agg(F.count(F.lit(1)).alias("bucket_size"), F.sum("_t").cast("bigint").alias("num_tuples"), F.sum("_k").cast("bigint").alias("num_kmers"))
    return out.withColumn("bucket_class", bucket_class(F.col("bucket_size")))


def bucket_ranges(found: DataFrame, slices: int = 1024) -> DataFrame:
    """``bucket_id`` dense by minimizer, with ``begin, end`` of its places in one flat list.

    Prefix sums in two levels: slices of the minimizer's high bits, then inside each slice.
    """
    rows = found.select("minimizer", "bucket_size")
    top = rows.agg(F.max("minimizer")).first()[0] or 0
    rows = rows.withColumn("_slice", F.floor(F.col("minimizer") / F.lit(top // slices + 1)).cast("bigint"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum("bucket_size").alias("_z"))
    totals = totals.select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_z").over(before), F.lit(0)).alias("_z0"))
    w = Window.partitionBy("_slice").orderBy("minimizer")
    rows = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_run", F.sum("bucket_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = not_broadcast(rows).join(totals, F.col("_slice") == F.col("_s"))
    end = F.col("_z0") + F.col("_run")
    return rows.select((F.col("_n0") + F.col("_i")).cast("bigint").alias("bucket_id"), "minimizer", (end - F.col("bucket_size")).cast("bigint").alias("begin"), end.cast("bigint").alias("end"))


def class_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("bucket_class").agg(F.count(F.lit(1)).alias("num_buckets"), F.sum("bucket_size").cast("bigint").alias("num_positions"), F.sum("num_kmers").cast("bigint").alias("num_kmers"))


def bucket_stats(found: DataFrame) -> DataFrame:
    """One row of counters over all buckets."""

    def total(col: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bucket_class") == name, F.col(col))), F.lit(0)).cast("bigint")

    classes = [("singleton", "singleton"), ("light", "light"), ("heavy", "heavy")]
    return found.agg(
        F.count(F.lit(1)).alias("num_buckets"),
        F.coalesce(F.sum("num_kmers"), F.lit(0)).cast("bigint").alias("num_kmers"),
        F.coalesce(F.sum("bucket_size"), F.lit(0)).cast("bigint").alias("num_positions"),
        F.coalesce(F.max("bucket_size"), F.lit(0)).cast("bigint").alias("max_bucket_size"),
        *[F.count_if(F.col("bucket_class") == c).alias(f"num_{a}_buckets") for c, a in classes],
        *[total("num_kmers", c).alias(f"num_kmers_in_{a}") for c, a in classes],
        F.coalesce(F.sum(F.when(F.col("bucket_class") != "singleton", F.col("num_tuples"))), F.lit(0)).cast("bigint").alias("num_super_kmers_in_non_singleton"),
    )


def bucket_shares(stats: DataFrame) -> DataFrame:
    """Percentages of the counters; null where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) * 100.0 / F.col(b), 6))
    names = ("singleton", "light", "heavy")
    return stats.select(*[share(f"num_{n}_buckets", "num_buckets").alias(f"pct_{n}_buckets") for n in names], *[share(f"num_kmers_in_{n}", "num_kmers").alias(f"pct_kmers_in_{n}") for n in names])


def skew_partitions(found: DataFrame) -> DataFrame:
    """Heavy buckets by size class: class c holds sizes up to 64 * 2**(c+1), the last class (7) all greater ones."""
    c = F.greatest(F.lit(0), F.least(ceil_log2(F.col("bucket_size")) - 7, F.lit(7)))
    heavy = found.filter(F.col("bucket_class") == "heavy")
    return heavy.groupBy(c.cast("int").alias("skew_partition")).agg(F.count(F.lit(1)).alias("num_buckets"), F.sum("num_kmers").cast("bigint").alias("num_kmers"), F.max("bucket_size").alias("max_bucket_size"))


def sorted_tuples(tuples: DataFrame) -> DataFrame:
    """Tuples in (minimizer, place) order; Spark sorts by ranges and spills."""
    return tuples.orderBy("minimizer", "pos_in_seq")


def merge_stats(tuples: DataFrame) -> DataFrame:
    places = tuples.groupBy("minimizer", "pos_in_seq").agg(F.count(F.lit(1)).alias("_t"))
    per = places.groupBy("minimizer").agg(F.count(F.lit(1)).alias("_p"), F.sum("_t").alias("_t"))
    return per.agg(F.count(F.lit(1)).alias("num_minimizers"), F.coalesce(F.sum("_p"), F.lit(0)).cast("bigint").alias("num_positions"), F.coalesce(F.sum("_t"), F.lit(0)).cast("bigint").alias("num_super_kmers"))
