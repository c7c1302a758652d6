"""what is shuffled and kept on disk by membership of windows, stored indexes and long k-mers."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import queries as Q
from strandloom.config import BuildConfig
from strandloom.operators import sketch, windows
from strandloom.plans import build_dictionary, load_dictionary

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def dictionary(spark, k):
    rng = random.Random(k)
    held = ["".join(rng.choices("ACGT", k=rng.randint(1, 200))) for _ in range(60)]
    held += [held[0], held[1][::-1].translate(str.maketrans("ACGT", "TGCA")), "A" * 90]
    reads = held[:30] + ["".join(rng.choices("ACGTNa", k=90)) for _ in range(9)] + [held[3].lower() + "N" + held[4], "漢" + held[5], None, ""]
    asked = spark.createDataFrame(list(enumerate(reads)), "id long, seq string")
    return build_dictionary(spark.createDataFrame(list(enumerate(held)), "id long, seq string"), BuildConfig(k=k, m=3)), asked


@pytest.mark.parametrize("k, most_bytes", [(31, sketch.MOST_BYTES), (9, 1)])
def test_sketched_windows_are_those_of_the_join(spark, k, most_bytes):
    d, asked = dictionary(spark, k)
    for absent in (True, False):
        got = sketch.windows_sketched(asked, d.known_runs, k, absent, most_bytes)
        assert rows(got) == rows(d.contains(windows.kmer_windows(asked, k), absent)) != []


@pytest.mark.parametrize("name", ["membership_sketched", "lookup_long"])
def test_windows_are_not_joined_one_by_one(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "Join" not in text and "hashpartitioning(_key" not in text


@pytest.mark.parametrize("k", [31, 63])
def test_an_index_is_stored_in_passes(spark, tmp_path, k):
    d, _ = dictionary(spark, k)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name, most in (("whole", 1 << 30), ("parts", 2000)):
        d.save(str(tmp_path / name), partitions=8, most=most)
        loaded = load_dictionary(spark, str(tmp_path / name))
        assert rows(loaded.index) == rows(d.index) and rows(loaded.strings) == rows(d.strings)
        held = spark.read.parquet(str(tmp_path / name / "index")).groupBy(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1).alias("b"))
        assert held.agg(F.count_distinct(F.input_file_name()).alias("n")).filter("n > 1").isEmpty()  # a bucket is one sorted file
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
