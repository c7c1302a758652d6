"""Sequences derived from the driver's tables, which hold no DNA."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandloom.functions import reverse_complement
from strandloom.staging import not_broadcast
from strandloom.staging import scratch as scratch

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def hashed(tags: str, col: str) -> Column:
    return F.concat(*[F.translate(F.md5(F.concat(F.lit(t), F.col(col).cast("string")).cast("binary")), HEX, BASES) for t in tags])


def seq_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seq``: 128 bases per part; every 31-mer is distinct on both strands."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    return part.select("id", hashed("abcd", "id").alias("seq"))


def seq_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seq``: the letters ACGT of every document, of any length, with repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("seq"))


def letters_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``seq_docs``, made in Arrow batches and without a pattern: bytes of a letter of several bytes are none of ACGT."""
    drop = bytes(set(range(256)) - set(b"ACGTacgt"))
    upper = bytes.maketrans(b"acgt", b"ACGT")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            seq = pa.array([None if x is None else x.translate(upper, drop) for x in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), seq], ["id", "seq"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(made, StructType([StructField("id", docs.schema["doc_id"].dataType), StructField("seq", StringType())]))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, seq``: reads of the parts' sequences, forward, reversed, absent, damaged, short and across ends."""
    part = seq_part(spark, sf_dir)
    after = part.select((F.col("id") - 1).alias("_id"), F.substring("seq", 1, 30).alias("_next"))
    rows = part.join(not_broadcast(after), F.col("id") == F.col("_id"), "left")
    cut = F.substring(F.col("seq"), (F.col("id") % 60 + 1).cast("int"), F.lit(60))
    absent = hashed("zy", "id")
    seq = (
        F.when(F.col("id") % 10 == 0, F.overlay(cut, F.lit("N"), F.lit(31), F.lit(1)))
        .when(F.col("id") % 5 == 0, F.overlay(cut, F.lit("N"), F.lit(6), F.lit(1)))
        .when(F.col("id") % 7 == 0, absent)
        .when(F.col("id") % 11 == 0, F.substring(cut, 1, 20))
        .when(F.col("id") % 13 == 0, F.lower(cut))
        .when((F.col("id") % 17 == 0) & F.col("_next").isNotNull(), F.concat(F.substring("seq", 99, 30), "_next"))
        .when(F.col("id") % 2 == 1, reverse_complement(cut))
        .otherwise(cut)
    )
    return rows.select(F.col("id").alias("query_id"), seq.alias("seq"))
