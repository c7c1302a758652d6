"""The same functions for SQL text, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "dna_reverse_complement": ("s STRING", "STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
    "kmer_pack": ("s STRING", "BIGINT", "cast(conv(reverse(translate(s, 'ACTG', '0123')), 4, 10) AS BIGINT)"),
    "kmer_unpack": ("b BIGINT, k INT", "STRING", "translate(reverse(lpad(conv(cast(b AS STRING), 10, 4), k, '0')), '0123', 'ACTG')"),
    "kmer_canonical": (
        "s STRING",
        "STRING",
        "CASE WHEN reverse(translate(s, 'ACTG', '0123')) < translate(translate(s, 'ACGT', 'TGCA'), 'ACTG', '0123') THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END",
    ),
    "dna_valid": ("s STRING", "BOOLEAN", "s RLIKE '^[ACGTacgt]*$'"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Make the functions callable by name in ``spark.sql`` for this session."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
