"""FASTA, FASTQ, plain text, k-mer lists and segment files, all through Spark's text reader.

Compressed files (.gz) are read by Hadoop's codecs.  Files of all kinds are split over tasks; a
FASTQ record has no mark that quality lines lack, so its lines are numbered over the splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandloom.functions import is_dna

FASTA_ENDS = (".fa", ".fasta", ".fa.gz", ".fasta.gz", ".fna", ".fna.gz")
FASTQ_ENDS = (".fq", ".fastq", ".fq.gz", ".fastq.gz")


def _checked(df: DataFrame, validate: bool) -> DataFrame:
    if not validate:
        return df
    wrong = F.raise_error(F.concat(F.lit("a sequence holds letters other than ACGT: "), F.substring("seq", 1, 60)))
    return df.withColumn("seq", F.when(is_dna(F.col("seq")), F.col("seq")).otherwise(wrong.cast("string")))


def read_fasta(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """``name, seq`` (upper case) of every record; sequence lines are joined."""
    # A record starts at a line's begin; the first one of a file keeps its sign.
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter(F.length(F.regexp_replace("value", r"\s", "")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    return _checked(raw.select(F.trim(head).alias("name"), body.alias("seq")), validate)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, _file, _line``: every line with its number in its file, from 0.

    Lines are counted split by split, and one total a split meets the others in a running sum;
    a split's lines follow each other in one task, so their own numbers need no order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    splits = lines.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    return lines.join(splits, ["_file", "_block"]).select("value", "_file", (F.col("_row") - F.col("_first") + F.col("_before")).alias("_line"))


def read_fastq(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """``name, seq, qual`` of every four-line record; blank lines after the last one are left out."""
    lines = _numbered_lines(spark, path)
    at = lambda k: F.max(F.when(F.col("_line") % 4 == k, F.col("value")))
    records = lines.groupBy("_file", F.floor(F.col("_line") / 4).alias("_record")).agg(at(0).alias("head"), F.upper(F.trim(at(1))).alias("seq"), at(2).alias("plus"), F.rtrim(at(3)).alias("qual"))
    found = records.filter(F.length(F.trim(F.concat_ws("", "head", "seq", "plus", "qual"))) > 0)
    broken = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("head", F.lit(""))))
    good = F.col("head").startswith("@") & F.coalesce(F.col("plus").startswith("+"), F.lit(False)) & (F.length("seq") == F.length("qual"))
    return _checked(found.select(F.when(good, F.expr("substring(head, 2)")).otherwise(broken.cast("string")).alias("name"), "seq", "qual"), validate)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """``seq`` (trimmed, upper case) of every line that is not blank."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("seq")).filter("seq <> ''")


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    """``kmer`` of every line that is not blank, of any length."""
    return read_plain(spark, path).withColumnRenamed("seq", "kmer")


def _segment_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` (from 1), ``text``, the ``id`` and ``seq`` parts of every line that is not blank, and ``reason``: what is wrong with it, else null."""
    rows = _numbered_lines(spark, path).select(F.col("_file").alias("file"), (F.col("_line") + 1).alias("line"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    rows = rows.withColumn("id", F.regexp_extract("text", r"^(\S+)", 1)).withColumn("seq", F.regexp_extract("text", r"^\S+\s+(.*)$", 1))
    reason = (
        F.when(~F.col("text").rlike(r"\s"), "no sequence")
        .when(~F.col("id").rlike("^[0-9]+$") | F.col("id").try_cast("bigint").isNull(), "no segment number")
        .when(~is_dna(F.col("seq")), "letters other than ACGT")
    )
    return rows.withColumn("reason", reason)


def read_segments(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``segment_id, seq`` of lines of a number, white space and bases.

    Any other line is an error that names its file, line and reason; if not ``strict``, such lines are left
    out, and ``segment_errors`` lists them.  A number has at most 63 bits.
    """
    rows = _segment_lines(spark, path)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a segment line: "), "reason", F.lit(" on line "), F.col("line").cast("string"), F.lit(" of "), "file", F.lit(": "), F.substring("text", 1, 80)))
        rows = rows.withColumn("id", F.when(F.col("reason").isNull(), F.col("id")).otherwise(wrong.cast("string")))
    else:
        rows = rows.filter("reason IS NULL")
    return rows.select(F.col("id").cast("bigint").alias("segment_id"), F.upper("seq").alias("seq"))


def segment_errors(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (its name), ``line, reason, text`` of every line of segment files that is none; lines are numbered over the splits of a file."""
    return _segment_lines(spark, path).filter("reason IS NOT NULL").select(F.substring_index("file", "/", -1).alias("file"), "line", "reason", "text")


def map_records(records: DataFrame, fn: Callable[[str | None, str], Iterable[tuple]], schema: str, name: str = "name") -> DataFrame:
    """Rows of the given schema that a function of your own makes of each record's name and sequence.

    ``fn`` runs on the executors, record by record inside Arrow batches, and gives any number of tuples.  A
    record without a sequence is passed over, a null name is given as None, an empty table gives no rows.  An
    error in ``fn`` fails the query and names the record.
    """
    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        for batch in batches:
            rows: list[tuple] = []
            for own, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq is None:
                    continue
                try:
                    rows += fn(own, seq)
                except Exception as e:
                    raise ValueError(f"the callback failed on record {own!r}: {e}") from e
            columns = list(zip(*rows)) if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return records.select(F.col(name).cast("string"), "seq").mapInArrow(run, kind)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``seq`` of a FASTA, FASTQ or plain file, told apart by its first character."""
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).head()
    start = first["value"].lstrip()[:1] if first else ""
    if start == ">":
        return read_fasta(spark, path, validate=False).select("seq")
    if start == "@":
        return read_fastq(spark, path, validate=False).select("seq")
    return read_plain(spark, path)


def is_sequence_file(path: str) -> bool:
    """Whether the name is that of a FASTA or FASTQ file or folder."""
    return path.rstrip("/").lower().endswith((*FASTA_ENDS, *FASTQ_ENDS))


def read_queries(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``kmer`` of a query file: all k-mers of sequence files, or the lines of a k-mer list."""
    from strandloom.operators.windows import kmer_windows

    if is_sequence_file(path) or path.rstrip("/").lower().endswith(".spss"):
        seqs = read_any(spark, path).withColumn("id", F.monotonically_increasing_id())
        return kmer_windows(seqs, k).select("kmer")
    return read_kmer_list(spark, path)


def sequence_counts(seqs: DataFrame) -> DataFrame:
    """``sequences, bases``: one row."""
    return seqs.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.length("seq").cast("bigint")), F.lit(0)).cast("bigint").alias("bases"))


def write_fasta(df: DataFrame, path: str, name: str = "id") -> None:
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col("seq"))).write.text(path)


def write_plain(df: DataFrame, path: str) -> None:
    df.select("seq").write.text(path)
