"""Bounded samples are the smallest hashed ids, whichever way they are drawn; entry points are complete."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import queries
from strandloom.llm.common import fresh, join_counted, number_rows, smallest_hashed


@pytest.mark.parametrize("n", [1, 10, 900])
def test_smallest_hashed(spark, n):
    rows = spark.range(1000).select(F.col("id").alias("_id"))
    want = {r[0] for r in rows.orderBy(F.xxhash64("_id")).limit(n).collect()}
    assert {r[0] for r in smallest_hashed(rows, n).collect()} == want
    assert smallest_hashed(rows.limit(0), n).count() == 0


def test_number_rows(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id").unionAll(spark.createDataFrame([(None, 7), (None, 7), (None, None)], "g long, id long"))
    for many in (503, 200_000_000):  # 64 and 200 slices
        got = number_rows(rows, ["g"], [F.col("id")], "n", many).collect()
        for g in (0, 1, 2, None):
            own = sorted(r.n for r in got if r.g == g)
            assert own == list(range(len(own))) and own


def test_join_counted_with_and_without_hot_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(7, "hot", 2000), (2500, "cold", 1), (2501, None, 1), (9999, "none", 0)], "key long, v string, n long")
    want = sorted([(7, i, 7, "hot") for i in range(2000)] + [(2500, 2500, 2500, "cold"), (2501, 2501, 2501, None)], key=str)
    for hot_rows in (100, 10_000):
        got = join_counted(left, right, "k", "key", "n", ["id"], hot_rows)
        assert got.columns == ["k", "id", "key", "v"] and sorted((tuple(r) for r in got.collect()), key=str) == want
        text = join_counted(left.withColumn("k", F.col("k").cast("string")), right.withColumn("key", F.col("key").cast("string")), "k", "key", "n", ["id"], hot_rows)
        assert sorted((tuple(r) for r in text.collect()), key=str) == [(str(a), b, str(c), d) for a, b, c, d in want]


def test_fresh_names():
    assert fresh(["a", "_X", "__x"], "_x") == "___x" and fresh([], "removed") == "removed"


def test_entry_points():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "packing"]


def test_pipeline_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, sf)
        assert out.columns == columns and out.schema == docs.schema, name
        if name != "secret_scans":
            assert out.join(before, columns, "left_anti").count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    assert packed.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()


CASES = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "password = 'q8Zt+Lw2!vR9xK' and more words here", None, None, None), (3, "password = 'q8Zt+Lw2!vR9xK' and more words here", None, None, None), (None, "plain words " * 30, "en", "s", 5)]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, _h string, _kept int, _kept_h int, _row int, _group int, removed int, _id int, _text int, `a.b` int, `x y` int, `q``t` int"


@pytest.mark.parametrize("rows", [CASES, []], ids=["odd rows", "empty table"])
def test_pipeline_stages_pass_odd_rows_and_names(spark, rows):
    """Nulls, empty texts, repeated rows, an empty table, and columns named like the operators' own."""
    docs = spark.createDataFrame([(*r, "x", *range(10)) for r in rows], NAMES)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "packing" or kept.schema == docs.schema, name
        out = kept.collect()
        ids = sorted((r.doc_id for r in out), key=str)
        if name == "near_duplicates":
            assert ids == ([1, 3, None] if rows else [])
        elif name == "quality_rules":
            assert all(r.doc_id is None for r in out)  # the others are short or empty
        else:
            assert ids == sorted((r[0] for r in rows), key=str), name
