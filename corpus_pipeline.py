"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Each stage but the last returns the columns it is given, of any names, and an empty table for an
empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import shared_dir
from strandloom.llm.decontaminate import drop_contaminated
from strandloom.llm.packing import pack_by_length
from strandloom.llm.quality_rules import drop_low_quality, train_line_model
from strandloom.llm.secrets import redact_secrets
from strandloom.llm.simhash import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line model keep, unchanged.

    Null, empty and very short texts go; repeated rows stay or go together.  Without labelled
    texts all lines count as content, so only the rules decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_low_quality(docs, train_line_model(docs, labels), min_share=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of five-word similarity 0.8 or more, unchanged.

    All null and blank texts are one group, as are equal texts; of rows that agree in id and
    text one stays, and a null id comes last.
    """
    return keep_one_of_each(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, unchanged.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark drops none.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars kept true.

    Null and empty texts stay as they are; repeated rows are changed each.
    """
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents in length buckets and token-budget batches.

    A null or empty text is one sequence of no tokens; repeated rows are packed each; further
    columns are left out.
    """
    return pack_by_length(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Trained and graph stages have no SQL.  Tests hold the operators of the stages against brute-force
#: versions, and the stages against planted documents, odd rows and clashing names.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
