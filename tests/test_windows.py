"""Windows cut in Arrow batches, against plain Python; no string function runs once a window."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import queries as Q
from strandloom.operators import lookups, strings, windows
from strandloom.plans import build_dictionary
from strandloom.config import BuildConfig

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def turned(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canonical(x):
    order = lambda y: y[::-1].translate(str.maketrans("ACTG", "0123"))
    return min(x, turned(x), key=order)


@pytest.mark.parametrize("k", [3, 31, 33, 63])
def test_canonical_windows(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (2, k, k + 1, 1300)] + ["A" * 600]
    right = sorted((i, p, s[p : p + k]) for i, s in enumerate(seqs) for p in range(len(s) - k + 1))
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    assert sorted(map(tuple, windows.canonical_windows(df, k).collect())) == [(i, p, canonical(x)) for i, p, x in right]
    keyed = windows.keyed_windows(df, k, ["id"]).select("id", "pos", lookups.kmer_of_key(F.col("key"), k), "own")
    assert sorted(map(tuple, keyed.collect())) == [(i, p, canonical(x), canonical(x) == x) for i, p, x in right]
    assert {r[0] for r in windows.window_keys(df, k, 3).select(lookups.kmer_of_key(F.col("key"), k)).collect()} == {canonical(x) for *_, x in right}


def test_query_windows_of_any_letters(spark):
    seqs = ["ACGTNACGTA", "acgtaß漢CGTAA", "GATTACA"]
    got = {(r["id"], r["pos"]): r for r in windows.query_windows(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), 5).collect()}
    assert set(got) == {(i, p) for i, s in enumerate(seqs) for p in range(len(s) - 4)}
    for (i, p), r in got.items():
        x = seqs[i][p : p + 5]
        assert r["kmer"] == x and r["valid"] == (set(x) <= set("ACGTacgt")) == (r["_key"] is not None)


def test_windows_are_not_cut_by_string_functions(spark):
    """reverse, translate and conv once a window took most of the time."""
    for name in ("canonical_kmer", "spss_violations"):
        text = plan(Q.QUERIES[name](spark, SF)).split("MapInArrow")[0]
        assert "translate(" not in text.replace("translate(reverse(lpad(conv", "") and "conv(substring" not in text


def test_sequences_are_made_once(spark):
    """The filter on lengths made them again, up to seven times a branch."""
    assert plan(Q.QUERIES["canonical_kmer"](spark, SF)).count("regexp_replace") == 1
    assert plan(Q.QUERIES["spss_strings"](spark, SF)).count("regexp_replace") <= 3  # strings, and their running offsets; 15 before


def test_places_are_made_behind_the_join(spark):
    """F32: ranges are joined chunk by chunk, and give what single places give."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((31, 40, 1100))], "id long, seq string")
    d = build_dictionary(df, BuildConfig(k=31, m=13))
    ranges = spark.createDataFrame([(0, -600, 3), (1, 9, 10), (2, -1, 1100), (2, 5, 4), (7, 0, 1)], "string_id long, first long, last long")
    right = d.access(ranges.filter("first <= last").select("string_id", F.explode(F.sequence("first", "last")).alias("pos")))
    got = d.access_ranges(ranges)
    assert got.count() == right.count() == 604 + 2 + 1102 + 2 and got.exceptAll(right).isEmpty()
    text = plan(Q.QUERIES["access_kmer"](spark, SF))
    assert text.index("explode(sequence(greatest") < text.index("Join")


def test_check_ships_keys_and_finds_what_is_missing(spark):
    """the own k-mers meet the index by key alone; letters are those that stand in the strings."""
    df = spark.createDataFrame([(0, "ACGTTGCAAC"), (1, "GGGGGTTTTT")], "id long, seq string")
    held = strings.string_set(df, 5)
    index = lookups.index_kmers(held.filter("string_id = 0"), 5)
    got = sorted(r[0] for r in lookups.missing_windows(held, index, 5).collect())
    assert got == ["GGGGG", "GGGGT", "GGGTT", "GGTTT", "GTTTT", "TTTTT"]
    top = plan(Q.QUERIES["self_check"](spark, SF)).split("Join")[1]
    assert "kmer_offset" not in top and "string_begin" not in top.split("MapInArrow")[0]


@pytest.mark.parametrize("name", ["kmer_union", "kmer_intersect", "kmer_except"])
def test_tasks_of_set_operations_grow_with_the_letters(spark, monkeypatch, name):
    """one task held a share of all k-mers that grew with the sets."""
    before = Q.QUERIES[name](spark, SF).rdd.getNumPartitions()
    monkeypatch.setattr(lookups, "KEYS_A_TASK", 1000)
    df = Q.QUERIES[name](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2 and before < 20 < df.rdd.getNumPartitions()
