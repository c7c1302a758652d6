"""F2, F3, F6, F8: strings scanned in their own dictionary are shuffled once, as folded runs; answers are those of the general scans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import queries as Q
from strandloom.config import BuildConfig
from strandloom.operators import own, seeds
from strandloom.operators.windows import fold, unfold
from strandloom.plans import build_dictionary

SF = "/root/testdata/sf0.001"


def turned(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def strings(k):
    """Copies, gradual changes, hairpins, shared passages and long runs on both strands."""
    rng = random.Random(k)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    held = [dna(rng.randint(1, 150)) for _ in range(15)] + [dna(700), "A" * 300, "AC" * 90]
    held += [held[15][:400] + held[3] + held[15][350:], turned(held[15])[100:500], held[15], held[15][:60] + turned(held[15][:60])]
    held += [held[4] + held[15][200:300] + held[5], turned(held[4] + held[15][200:300]) + held[6], "ACG", "", dna(50) + held[16]]
    changed = list(held[15])
    changed[333] = "A" if changed[333] != "A" else "C"
    return [*held, "".join(changed), turned("".join(changed))]


def dictionary(spark, k, canonical):
    rows = [(i, 100 - i, s) for i, s in enumerate(strings(k))]
    return build_dictionary(spark.createDataFrame(rows, "id long, name long, seq string"), BuildConfig(k=k, m=3, canonical=canonical))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("k, canonical, least", [(31, True, own.HEAVY), (7, False, 5), (63, True, 0)])
def test_own_lookups_answer_as_the_index(spark, k, canonical, least):
    d = dictionary(spark, k, canonical)
    d.own_strings.createOrReplaceTempView("own")
    reads = d.own_strings.select("name", "seq")
    want = d.query(Q.windows.kmer_windows(reads, k)).withColumn("valid", F.lit(True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = own.lookup_own(d.strings, k, canonical, least)
        assert rows(got) == rows(want.select(got.columns)) and got.count() > 2000
        both = own.both_strands(d.own_strings)
        want = d.query(Q.windows.kmer_windows(both, k)).select("query_id", "pos", "kmer_offset", "orientation")
        names = d.own_strings.select("string_id", F.col("name").alias("_name"))
        got = own.lookup_both_strands(d.strings, k, canonical, least).join(names, F.col("name") == F.col("_name"))
        got = got.select(F.when(F.col("turned"), -1 - F.col("string_id")).otherwise(F.col("string_id")).alias("query_id"), "pos", "kmer_offset", "orientation")
        assert rows(got) == rows(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("k, block, least", [(31, 1 << 16, own.HEAVY), (9, 70, 3)])
def test_own_searches_are_those_of_a_followed_scan(spark, k, block, least):
    d = dictionary(spark, k, False)
    reads = own.both_strands(d.own_strings)
    want = seeds.seeded_runs(d.query(Q.windows.kmer_windows(reads, k)), reads, d.strings, k)
    got = own.own_searches(d.own_strings, k, block, least)
    assert rows(got.select(want.columns)) == rows(want)
    if block > 1000:
        assert rows(d.stats_own()) == rows(d.stats(reads)) and d.stats_own().columns == d.stats(reads).columns


def test_no_strings(spark):
    d = build_dictionary(spark.createDataFrame([(1, "ACG")], "id long, seq string"), BuildConfig(k=31, m=3))
    assert d.query_own().count() == d.query_own_turned().count() == d.runs_own().count() == 0
    assert rows(d.stats_own()) == rows(d.stats(own.both_strands(d.own_strings)))


def test_folded_strings():
    texts = ["", "A", "ACGTACGTA", "ACGN", "acgt", "ß漢A", "GGGG"]
    assert unfold(fold(pa.array(texts))).to_pylist() == texts and unfold(fold(pa.array(texts * 9)).slice(5, 20)).to_pylist() == (texts * 9)[5:25]
    assert fold(pa.array(["ACGT" * 100])).nbytes < 120


def test_one_side_is_shuffled(spark):
    """Reads and strings were shuffled apart, with a byte for each letter."""
    for name in ("lookup_canonical", "minimizer_join_canonical"):
        text = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and text.count("Scan") == 1 and "Join" not in text
