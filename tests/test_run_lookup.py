"""scans of a dictionary that is not stored meet runs of windows; answers are those of the index, and no k-mer is shuffled."""

import random

import pytest

from strandloom import queries as Q
from strandloom.config import BuildConfig
from strandloom.operators import lookups, scan
from strandloom.plans import build_dictionary, load_dictionary

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def turned(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def tables(spark, k):
    """Repeats on both strands, long runs of one letter, letters other than ACGT, lower case, short and missing sequences."""
    rng = random.Random(k)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    held = [dna(rng.randint(1, 90)) for _ in range(40)] + [dna(1300), "A" * 700, "ACGT" * 50, "AC" * 90]
    held += [turned(held[0]), held[1], turned(held[40])[100:400]] + [dna(12) + "AAACCCGGT" + dna(12) for _ in range(30)]
    reads = [s if i % 2 else turned(s) for i, s in enumerate(held)] + [dna(80), held[40][:300] + "N" + held[40][301:].lower(), "", "ACG", "T" * 600, "N" * 700]
    reads += ["acgtaß漢" + held[40][5:90] + "漢" + held[40][:70], None]
    asked = [(i % 7, None if i % 5 == 0 else str(i), s) for i, s in enumerate(reads)]
    return spark.createDataFrame(list(enumerate(held)), "id long, seq string"), spark.createDataFrame(asked, "string_id long, name string, seq string")


@pytest.mark.parametrize("k, canonical, limits", [(31, True, None), (31, False, (40, 40)), (15, True, (0, 0)), (5, False, None), (5, True, (100, 10**9)), (3, True, None), (63, True, (10**9, 20)), (33, False, None)])
def test_runs_answer_as_the_index(spark, k, canonical, limits):
    seqs, reads = tables(spark, k)
    d = build_dictionary(seqs, BuildConfig(k=k, m=2, canonical=canonical))
    reads = reads.withColumnRenamed("string_id", "query_id")
    want = scan.scan_lookup(reads, d.index, k, canonical)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # runs of one minimizer come in several batches
    try:
        got = d.stream_query(reads) if limits is None else lookups.lookup_runs(reads, d.known_runs, k, canonical, limits)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        rows = sorted(map(str, got.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == sorted(map(str, want.collect())) and any("found=True" in r for r in rows)


@pytest.mark.parametrize("name", ["lookup_canonical", "lookup_offset"])
def test_no_kmer_is_shuffled(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "Join" not in text and text.count("Exchange") == 1 and "regexp_replace" not in text


def test_runs_of_one_kmer_are_short_and_none_is_lost(spark):
    seqs, reads = tables(spark, 31)
    runs = lookups.window_runs(reads, 31, ["name"]).collect()
    assert sum(r["_size"] for r in runs) == sum(max(0, len(r["seq"] or "") - 30) for r in reads.collect())
    assert max(r["_size"] for r in runs) <= 64 and all(len(r["_piece"]) == r["_size"] + 30 for r in runs)


def test_a_stored_index_is_still_joined(spark, tmp_path):
    seqs, reads = tables(spark, 31)
    d = build_dictionary(seqs, BuildConfig(k=31, m=13))
    d.save(str(tmp_path / "d"))
    loaded = load_dictionary(spark, str(tmp_path / "d"))
    reads = reads.withColumnRenamed("string_id", "query_id")
    assert "Join" in plan(loaded.stream_query(reads)) and sorted(map(str, loaded.stream_query(reads).collect())) == sorted(map(str, d.stream_query(reads).collect()))
