"""Record borders of sequence files, over splits; windows of reads with invalid letters; set operations."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import functions, sources
from strandloom.config import BuildConfig
from strandloom.operators import lookups, strings, windows
from strandloom.plans import build_dictionary, build_from_chunks


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta_records_start_at_line_begins(spark, tmp_path, small_splits):
    (tmp_path / "a.fa").write_bytes(b"\r\n>chr1 variant A->G\r\nACGT\r\nACGT\r\n>empty\r\n>two > one\r\nTT\r\n\r\nTT")
    assert sorted(tuple(r) for r in sources.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("chr1 variant A->G", "ACGTACGT"), ("empty", ""), ("two > one", "TTTT")]
    rng = random.Random(1)
    rows = [(f"r{i} x->y", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 300)))) for i in range(200)]
    (tmp_path / "b.fa").write_text("".join(f">{n}\n" + "".join(f"{s[k:k + 60]}\n" for k in range(0, len(s), 60)) for n, s in rows))
    found = sources.read_fasta(spark, str(tmp_path / "b.fa"))
    assert found.rdd.getNumPartitions() > 10 and sorted(tuple(r) for r in found.collect()) == sorted(rows)


def test_fastq_is_split_and_whole(spark, tmp_path, small_splits):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        n = rng.randint(1, 90)
        rows.append((f"read {i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+>I#") for _ in range(n))))
    folder = tmp_path / "reads.fq"
    folder.mkdir()
    for k in range(3):
        end = "\r\n" if k == 1 else "\n"
        (folder / f"{k}.fq").write_bytes("".join(f"@{n}{end}{s}{end}+{end}{q}{end}" for n, s, q in rows[k::3]).encode() + b"\n\n" * (k == 2))
    found = sources.read_fastq(spark, str(folder))
    assert sorted(tuple(r) for r in found.collect()) == sorted(rows)
    (tmp_path / "none.fq").write_text("")
    assert sources.read_fastq(spark, str(tmp_path / "none.fq")).count() == 0


def test_reads_with_invalid_letters_keep_their_clean_windows(spark):
    rng = random.Random(3)
    stored = "".join(rng.choice("ACGT") for _ in range(400))
    texts = ["N" + stored[:100], stored[50:120] + "nn" + stored[200:260].lower() + "N", "N" * 40, "", stored]
    reads = spark.createDataFrame(list(enumerate(texts)), "query_id long, seq string")
    held = strings.string_set(spark.createDataFrame([(0, stored)], "id long, seq string"), 31)
    want = {(i, p): stored.find(t[p : p + 31].upper()) for i, t in enumerate(texts) for p in range(len(t) - 30) if t[p : p + 31].upper() in stored}
    assert {(r.query_id, r.pos): r.kmer_offset for r in lookups.minimizer_join(reads, held, 31, 13).collect()} == want and len(want) > 400
    assert {(r.query_id, r.offset, r.seq) for r in windows.stretches(reads, 31).collect()} == {(0, 1, stored[:100]), (1, 0, stored[50:120]), (1, 72, stored[200:260]), (4, 0, stored)}


def test_chunks_of_one_long_sequence_are_dealt_over_all_tasks(spark):
    long = "".join(random.Random(4).choices("ACGT", k=200_000))
    rows = windows.kmer_windows(spark.createDataFrame([(0, long)], "id long, seq string"), 31)
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 200_000 - 30 and len(per_task) == 4 and max(per_task) < 2 * min(per_task)


def test_segment_errors_by_file_and_line(spark, tmp_path):
    lines = ["7\tACGT", "", "x ACGT", "8", "  9   acgt  ", "10 ACNT", "99999999999999999999 ACGT", "-3 ACGT", "11 AC GT"]
    (tmp_path / "a.seg").write_text("\n".join(lines) + "\n")
    many = [f"{i} ACGT" if i % 1000 else f"{i} AXGT" for i in range(1, 20_001)]
    (tmp_path / "b.seg").write_text("\n".join(many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # files in many splits
    try:
        got = sorted(tuple(r) for r in sources.segment_errors(spark, str(tmp_path)).collect())
        good = sorted(tuple(r) for r in sources.read_segments(spark, str(tmp_path), strict=False).collect())
        with pytest.raises(Exception, match=r"not a segment line: [\w ]+ on line [34789] of"):
            sources.read_segments(spark, str(tmp_path / "a.seg")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([
        ("a.seg", 3, "no segment number", "x ACGT"), ("a.seg", 4, "no sequence", "8"), ("a.seg", 6, "letters other than ACGT", "10 ACNT"),
        ("a.seg", 7, "no segment number", "99999999999999999999 ACGT"), ("a.seg", 8, "no segment number", "-3 ACGT"), ("a.seg", 9, "letters other than ACGT", "11 AC GT"),
        *[("b.seg", i, "letters other than ACGT", f"{i} AXGT") for i in range(1000, 20_001, 1000)],
    ])
    assert good == sorted([(7, "ACGT"), (9, "ACGT"), *[(i, "ACGT") for i in range(1, 20_001) if i % 1000]])
    (tmp_path / "none.seg").write_text("")
    assert sources.segment_errors(spark, str(tmp_path / "none.seg")).count() == 0


def test_map_records(spark):
    rows = spark.createDataFrame([("a", "ACGT"), (None, ""), ("n", None), ("b", "GG")], "name string, seq string")
    out = sources.map_records(rows, lambda name, seq: [(name, len(seq), c) for c in seq], "name string, n int, base string")
    assert sorted(map(tuple, out.collect())) == [("a", 4, c) for c in "ACGT"] + [("b", 2, "G")] * 2 and out.columns == ["name", "n", "base"]
    assert sources.map_records(rows.limit(0), lambda name, seq: [(1,)], "n int").count() == 0
    assert sources.map_records(rows, lambda name, seq: [(name,)], "name string").filter("name IS NULL").count() == 1

    def strict(name, seq):
        if not seq:
            raise RuntimeError("nothing there")
        return []

    with pytest.raises(Exception, match="the callback failed on record None: nothing there"):
        sources.map_records(rows, strict, "n int").collect()


def test_table_functions(spark):
    functions.register_table_functions(spark)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 5, 9, 10, 60, 700])] + [(9, None), (10, "A" * 40), (11, "acgtacgtacgt")]
    spark.createDataFrame(rows, "string_id long, seq string").createOrReplaceTempView("held")
    got = {(r.string_id, r.pos): r.kmer for r in spark.sql("SELECT * FROM held, LATERAL kmers(seq, 9)").collect()}
    assert got == {(i, p): s[p : p + 9] for i, s in rows if s for p in range(len(s) - 8)}
    runs = spark.sql("SELECT string_id, first_pos, minimizer, pos_in_kmer, num_kmers FROM held, LATERAL super_kmers(seq, 9, 4, 1)")
    plain = windows.super_kmers(spark.table("held").filter("seq IS NOT NULL").selectExpr("string_id", "0L AS string_begin", "upper(seq) AS seq"), 9, 4)
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, plain.select(*runs.columns).collect()))
    for sql, error in (("kmers('ACGT', 0)", "k must be positive"), ("super_kmers('ACGT', 3, 3, 1)", "m must be"), ("super_kmers('ACNTACGTAA', 5, 3, 1)", "letters other")):
        with pytest.raises(Exception, match=error):
            spark.sql(f"SELECT * FROM {sql}").collect()


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_records_in_chunks_give_the_same_dictionary(spark, tmp_path, size):
    """Lines of any length, records over many splits and chunks, blank lines, a record without letters, several files."""
    rng = random.Random(size)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    files = {"a.fa": [("one x", base(900)), ("two", ""), ("three", base(10)), ("four", base(11).lower())], "b.fa": [("five", base(300)), ("six", base(5000))]}
    for name, records in files.items():
        text = ""
        for head, seq in records:
            width = rng.randint(5, 90)
            text += f">{head}\r\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width)) + rng.choice(["", "\n"])
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sources.read_fasta_chunks(spark, str(tmp_path), 11, size=size).collect()
        d = build_from_chunks(spark.createDataFrame(rows), BuildConfig(k=11, m=3), size=size)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = [(head, seq.upper()) for records in files.values() for head, seq in records]
    want = sorted((head, c, len(seq), seq[c * size : c * size + size + 10]) for head, seq in whole for c in range(max(0, -(-(len(seq) - 10) // size))))
    assert sorted((r.name, r.chunk, r.length, r.seq) for r in rows) == want
    plain = build_dictionary(spark.createDataFrame(list(enumerate(s for _, s in whole)), "id long, seq string"), BuildConfig(k=11, m=3))
    asked = windows.kmer_windows(plain.strings, 11, []).select("kmer").distinct()
    assert sorted(map(str, d.query(asked).collect())) == sorted(map(str, plain.query(asked).collect()))
    assert d.is_unique == plain.is_unique
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.fa").write_text("ACGT\n>x\nACGTACGTACGT\n")
    with pytest.raises(Exception, match="before the first header"):
        sources.read_fasta_chunks(spark, str(tmp_path / "bad"), 3).collect()
