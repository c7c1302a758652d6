"""Joins whose sides are estimated far too small: none of them may be sent whole to every executor."""

import pytest
from pyspark.sql import functions as F

from strandloom import fixtures as X
from strandloom import queries as Q
from strandloom.operators import seeds, strings

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lookup_full", "lookup_orientation", "lookup_long", "lookup_offset", "lookup_canonical", "stream_lookup", "stream_check", "query_report"])
def test_an_index_is_never_broadcast(spark, name):
    assert "Broadcast" not in plan(Q.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["membership_semi", "membership_anti", "membership_sketched"])
def test_membership_never_broadcasts_an_index(spark, name):
    assert "BroadcastHashJoin" not in plan(Q.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["minimizer_join", "minimizer_found", "kmer_intersect", "kmer_except"])
def test_joins_of_exploded_tables_never_broadcast(spark, name):
    assert "Broadcast" not in plan(Q.QUERIES[name](spark, SF))


def test_strings_are_never_broadcast_to_be_numbered(spark):
    assert "Broadcast" not in plan(strings.string_set(X.seq_part(spark, SF), Q.K))


def shuffled_parts(spark, path, n=40):
    """The parts of sf0.001 in files that each hold keys from everywhere, as larger tables come to several tasks."""
    spark.read.parquet(f"{SF}/part.parquet").repartition(n, F.xxhash64("p_partkey")).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_chunked_records_keep_their_order(spark, tmp_path):
    sf_dir = shuffled_parts(spark, tmp_path)
    cols = ["query_id", "pos", "kmer_id", "kmer_offset", "orientation", "string_id"]
    found, right = (Q.QUERIES[q](spark, sf_dir).select(cols) for q in ("lookup_chunked", "lookup_full"))
    assert found.count() == right.count() and found.exceptAll(right).isEmpty()


def test_super_kmers_of_sql_are_made_by_all_tasks(spark):
    df = Q.QUERIES["super_kmers_sql"](spark, SF)
    assert len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}) > 1


def test_strings_and_places_are_dealt_over_tasks(spark):
    """Ids of one dense range are slices of many tasks, and a k-mer at a place is found by one join."""
    ids = spark.range(40_000).select("id", F.lit("ACGT" * 10).alias("seq"))
    held = strings.string_set(ids, Q.K)
    assert held.select(F.floor(F.col("string_id") / strings.SLICE)).distinct().count() > 4
    asked = spark.range(0, 200).select(F.col("id").alias("pos"))
    assert plan(strings.kmer_at(asked, held, Q.K)).count("Join") == plan(strings.locate(asked, held)).count("Join")


def test_shared_letters(spark):
    """A piece that has no text, as behind the last chunk of a read, shares no letter."""
    cases = [(None, "ACG", 3, 0), ("ACG", None, 3, 0), ("", "ACG", 3, 0), ("ACG", "ACG", 3, 3), ("ACGT", "ACT", 4, 2), ("AC", "ACGT", 4, 2)]
    cases += [("A" * i + "C" * (256 - i), "A" * 256, 256, i) for i in (0, 1, 127, 128, 200, 255, 256)]
    rows = spark.createDataFrame([(*c, k) for k, c in enumerate(cases)], "x string, y string, n int, right long, at int")
    found = rows.select("right", seeds._same_letters(F.col("x"), F.col("y"), F.col("n")).alias("found")).orderBy("at").collect()
    assert [r["found"] for r in found] == [c[3] for c in cases]
