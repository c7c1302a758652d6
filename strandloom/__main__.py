"""Command line: ``python -m strandloom build|query|check|bench``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import BuildConfig
from strandloom.fixtures import BASES, HEX
from strandloom.operators import buckets, reports, scan
from strandloom.operators.windows import kmer_windows, spread
from strandloom.plans import KmerDictionary, build_dictionary, load_dictionary
from strandloom.sources import is_sequence_file, read_any, read_queries


def numbered(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """The sequences of a file, numbered in the order of the file's splits."""
    return read_any(spark, path).withColumn(name, F.monotonically_increasing_id())


def shown(df: DataFrame) -> str:
    """The columns of a one-row report, a line each."""
    return "\n".join(f"{k}: {v}" for k, v in df.first().asDict().items())


def build(spark: SparkSession, a: argparse.Namespace) -> str:
    config = BuildConfig(k=a.k, m=a.m, canonical=a.canonical, seed=a.seed, on_invalid="split" if a.split_invalid else "error")
    d = build_dictionary(numbered(spark, a.input), config)
    d.save(a.output)
    d = load_dictionary(spark, a.output)
    out = shown(d.totals())
    if a.verbose:
        stats = buckets.bucket_stats(d.buckets)
        out += "\n" + "\n".join(shown(x) for x in (stats, buckets.bucket_shares(stats), reports.space_model(d.totals(), stats)))
    return out


def query(spark: SparkSession, a: argparse.Namespace) -> str:
    d = load_dictionary(spark, a.index)
    if a.streaming:
        if not is_sequence_file(a.query):
            raise SystemExit("--streaming takes FASTA or FASTQ files: " + a.query)
        return shown(d.stats(numbered(spark, a.query, "query_id")))
    return shown(reports.point_report(d.query(read_queries(spark, a.query, d.config.k))))


def check(spark: SparkSession, a: argparse.Namespace) -> str:
    """All k-mers of a file must be found; with ``--streaming`` the scan must equal direct lookups."""
    d = load_dictionary(spark, a.index)
    if a.streaming:
        found = d.stream_query(numbered(spark, a.file, "query_id"))
        return shown(scan.scan_check(found, d.index, d.config.k, d.config.canonical))
    own = kmer_windows(numbered(spark, a.file), d.config.k).select("kmer")
    found = d.query(own)
    missing = [r["kmer"] for r in reports.self_check(found).collect()]
    return shown(reports.point_report(found)) + ("\nall found" if not missing else "\nmissing: " + " ".join(missing))


def stored_kmers(d: KmerDictionary, rows: int) -> DataFrame:
    return spread(kmer_windows(d.strings.select("string_id", "seq"), d.config.k, []).limit(rows), "kmer")


def bench(spark: SparkSession, a: argparse.Namespace) -> str:
    """Seconds of positive lookups, negative lookups and locates of so many rows, the index in memory."""
    d = load_dictionary(spark, a.index)
    d = KmerDictionary(d.config, d.strings.persist(), d.index.persist())
    letters = F.concat(*[F.md5(F.concat(F.lit(t), F.col("id").cast("string")).cast("binary")) for t in "qr"])
    absent = spark.range(a.rows).select(F.substring(F.translate(letters, HEX, BASES), 1, d.config.k).alias("kmer"))
    bases = d.strings.agg(F.max("string_end")).first()[0] or 1
    places = spark.range(a.rows).select(F.pmod(F.xxhash64("id"), F.lit(bases)).alias("pos"))
    own = stored_kmers(d, a.rows).persist()
    d.index.count(), own.count()
    lines = []
    for name, plan in (("positive lookup", d.query(own)), ("negative lookup", d.query(absent)), ("locate", d.locate(places))):
        began = time.perf_counter()
        plan.write.format("noop").mode("overwrite").save()
        lines.append(f"{name}: {time.perf_counter() - began:.3f} s")
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build", help="build a dictionary from a sequence file")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-k", type=int, default=31)
    p.add_argument("-m", type=int, default=19)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--canonical", action="store_true")
    p.add_argument("--split-invalid", action="store_true", help="cut sequences at letters other than ACGT instead of failing")
    p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("query", help="look up the k-mers of a file")
    p.add_argument("-i", "--index", required=True)
    p.add_argument("-q", "--query", required=True)
    p.add_argument("--streaming", action="store_true")
    p = sub.add_parser("check", help="hold a dictionary against a file")
    p.add_argument("-i", "--index", required=True)
    p.add_argument("-f", "--file", required=True)
    p.add_argument("--streaming", action="store_true")
    p = sub.add_parser("bench", help="time lookups")
    p.add_argument("-i", "--index", required=True)
    p.add_argument("--rows", type=int, default=1_000_000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    out = {"build": build, "query": query, "check": check, "bench": bench}[args.command](spark, args)
    print(out)
    return out


if __name__ == "__main__":
    main()
