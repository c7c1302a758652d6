"""Functions, operators and files against literals and a plain Python dictionary."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom import functions as fn
from strandloom import sources
from strandloom.config import BuildConfig, is_valid_k
from strandloom.operators import buckets as B
from strandloom.operators import lookups, scan, seeds, strings, windows
from strandloom.operators import sketch as sketches
from strandloom.plans import build_dictionary, load_dictionary
from strandloom.plans.dictionary import DictionaryFormatError, occurrences
from strandloom.streaming import chunk_scan, read_stream, run_once, stream_scan
from strandloom.streaming.reads import window_counts

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def bits(s):
    return sum("ACTG".index(c) << 2 * i for i, c in enumerate(s))


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def seqs_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, seq string")


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_literals(spark):
    for a, b in (("ACGTG", "CACGT"), ("ACGTACG", "CGTACGT"), ("", "")):
        assert one(spark, fn.reverse_complement(F.lit(a))) == b
    assert one(spark, fn.set_base(fn.set_base(F.lit("AAAAA"), 2, F.lit("T")), 4, F.lit("G"))) == "AATAG"
    assert one(spark, fn.append_base(F.lit("ACGTA"), F.lit("G"), 5)) == "GACGT"
    assert one(spark, fn.encode_bases(F.lit("acTG"))) == "0123" and one(spark, fn.encode_bases(F.lit("acN"))) is None
    assert one(spark, fn.pack(F.lit("G" * 31))) == 4**31 - 1
    assert [one(spark, fn.ceil_log2(F.lit(n))) for n in (0, 1, 2, 3, 4, 5, 64, 65, 1 << 40)] == [0, 0, 1, 2, 2, 3, 6, 7, 40]
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 64, 65, 1000)], "n int").select(B.bucket_class(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["singleton", "light", "light", "heavy", "heavy"]


@pytest.mark.parametrize("k", [1, 5, 31])
def test_kmer_algebra(spark, k):
    rng = random.Random(k)
    rows = [dna(rng, k) for _ in range(200)]
    d = spark.createDataFrame([(r,) for r in rows], "s string")
    s = F.col("s")
    for r in d.select("s", fn.pack(s).alias("p"), fn.unpack(fn.pack(s), k).alias("u"), fn.canonical(s).alias("c"), fn.canonical(fn.reverse_complement(s)).alias("cr")).collect():
        assert r.p == bits(r.s) and r.u == r.s
        want = min(r.s, rc(r.s), key=bits)
        assert r.c == want and (r.cr == want or r.s == rc(r.s))
    for r in d.select("s", fn.unpack_bytes(fn.pack_bytes(s), F.length(s)).alias("b")).collect():
        assert r.b == r.s


def test_pack_bytes_of_all_lengths(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(dna(rng, n),) for n in range(0, 40)], "s string")
    for r in d.select("s", fn.pack_bytes(F.col("s")).alias("b"), fn.unpack_bytes(fn.pack_bytes(F.col("s")), F.length("s")).alias("u")).collect():
        want = bytes(sum("ACTG".index(c) << 2 * i for i, c in enumerate(r.s[a : a + 4])) for a in range(0, len(r.s), 4))
        assert bytes(r.b) == want and r.u == r.s


def test_config():
    assert [k for k in range(70) if is_valid_k(k)] == list(range(3, 64, 2))
    for bad in ({"k": 4}, {"k": 65}, {"k": 31, "m": 31}, {"m": 0}, {"k": 63, "m": 32}, {"on_invalid": "skip"}):
        with pytest.raises(ValueError):
            BuildConfig(**bad)


def test_sql_functions(spark):
    fn.register_sql_functions(spark)
    row = spark.sql("SELECT dna_reverse_complement('ACGTG') a, kmer_unpack(kmer_pack('ACGTG'), 5) b, kmer_canonical('GGGAA') c, dna_valid('acgN') d").first()
    assert tuple(row) == ("CACGT", "ACGTG", min("GGGAA", "TTCCC", key=bits), False)


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nacg\n\n>two\nTTTT\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nACGTA\nCC\n")
    (tmp_path / "c.fq").write_text("@r1\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")
    (tmp_path / "d.txt").write_text("\n  acgt \n\nTTAA\n")
    (tmp_path / "e.seg").write_text("7\tACGT\n\n3  ttt\n")
    read = lambda f, name: sorted(tuple(r) for r in f(spark, str(tmp_path / name)).collect())
    assert read(sources.read_fasta, "a.fa") == [("one x", "ACGTACG"), ("two", "TTTT")]
    assert read(sources.read_fasta, "b.fa.gz") == [("z", "ACGTACC")]
    assert read(sources.read_fastq, "c.fq") == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
    assert read(sources.read_plain, "d.txt") == [("ACGT",), ("TTAA",)] == read(sources.read_kmer_list, "d.txt")
    assert read(sources.read_segments, "e.seg") == [(3, "TTT"), (7, "ACGT")]
    for name, n in (("a.fa", 2), ("b.fa.gz", 1), ("c.fq", 2), ("d.txt", 2)):
        assert sources.read_any(spark, str(tmp_path / name)).count() == n
    assert tuple(sources.sequence_counts(sources.read_fasta(spark, str(tmp_path / "a.fa"))).first()) == (2, 11)
    assert sources.read_queries(spark, str(tmp_path / "a.fa"), 5).count() == 3
    assert sources.read_queries(spark, str(tmp_path / "d.txt"), 5).count() == 2
    (tmp_path / "n.fa").write_text(">a\nACNT\n")
    (tmp_path / "n.seg").write_text("x ACGT\n")
    (tmp_path / "n.fq").write_text("@r\nACGT\n-\nIIII\n")
    for f, name in ((sources.read_fasta, "n.fa"), (sources.read_segments, "n.seg"), (sources.read_fastq, "n.fq")):
        with pytest.raises(Exception, match="letters other|not a"):
            read(f, name)
    assert read(lambda s, p: sources.read_fasta(s, p, validate=False), "n.fa") == [("a", "ACNT")]


def test_string_set(spark):
    d = seqs_of(spark, ["ACGTACGT", "ACGT", "ACGTACG", None])
    got = strings.string_set(d, 5).orderBy("string_id").collect()
    assert [(r.string_id, r.string_begin, r.string_end) for r in got] == [(0, 0, 8), (1, 8, 15)]
    assert windows.kmer_windows(strings.string_set(d, 5), 5).count() == 7
    bad = seqs_of(spark, ["ACGTANCGTAC", "nnn"])
    with pytest.raises(Exception, match="letters other"):
        strings.string_set(bad, 5).collect()
    assert [r.seq for r in strings.string_set(bad, 5, "split").orderBy("string_id").collect()] == ["ACGTA", "CGTAC"]
    # Ids over many slices of the order column.
    many = spark.range(0, 40).select((F.col("id") * 50_000).alias("id"), F.lit("ACGTA").alias("seq"))
    assert [(r.string_id, r.string_begin) for r in strings.string_set(many, 5).orderBy("string_id").collect()] == [(i, 5 * i) for i in range(40)]
    # Ids that are hashes, negative ones too.
    hashed = spark.range(0, 300).select(F.xxhash64("id").alias("id"), F.concat(F.lit("ACGTA"), F.repeat(F.lit("C"), (F.col("id") % 7).cast("int"))).alias("seq"))
    rows = sorted((r.id, r.seq) for r in hashed.collect())
    got = strings.string_set(hashed, 5).orderBy("string_id").collect()
    assert [(r.string_id, r.string_begin, r.seq) for r in got] == [(i, sum(len(s) for _, s in rows[:i]), seq) for i, (_, seq) in enumerate(rows)]


def test_locate(spark):
    ends = spark.createDataFrame([(i, 100 * i, 100 * i + 100) for i in range(4)], "string_id long, string_begin long, string_end long")
    pos = spark.createDataFrame([(p,) for p in (50, 100, 199, 300, 399, 400)], "pos long")
    for width in (1, 7, 4096):
        got = {r.pos: r.string_id for r in strings.locate(pos, ends, width=width).collect()}
        assert got == {50: 0, 100: 1, 199: 1, 300: 3, 399: 3, 400: None}
    plan = strings.locate(pos, ends)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def py_minimizer(kmer, m, canonical):
    def mix(v):
        return (v ^ 1431655765) % 2147483647 * 48271 % 2147483647

    def best(s):
        return min((mix(bits(s[i : i + m])), i, bits(s[i : i + m])) for i in range(len(s) - m + 1))

    h, i, v = best(kmer)
    if canonical:
        _, j, w = best(rc(kmer))
        if w < v:
            return w, len(kmer) - m - j
    return v, i


@pytest.mark.parametrize("canonical", [False, True])
def test_minimizers_and_super_kmers(spark, canonical):
    rng = random.Random(7)
    rows = [dna(rng, n) for n in (9, 31, 80, 140, 511, 512, 513, 520, 521, 1100, 5000)] + ["ACGT" * 16, "A" * 40, "ACGTACG"]
    d = seqs_of(spark, rows)
    got = {(r.id, r.pos): (r.minimizer, r.pos_in_kmer) for r in windows.minimizers(d, 9, 4, canonical).collect()}
    want = {(i, p): py_minimizer(s[p : p + 9], 4, canonical) for i, s in enumerate(rows) for p in range(len(s) - 8)}
    assert got == want
    tuples = windows.super_kmers(strings.string_set(d, 9), 9, 4, canonical)
    runs = tuples.collect()
    assert sum(r.num_kmers for r in runs) == len(want)
    for r in runs:
        for j in range(r.num_kmers):
            assert want[r.string_id, r.first_pos + j] == (r.minimizer, r.pos_in_kmer - j)
    assert B.bucket_stats(B.buckets(tuples)).first().num_kmers == len(want)
    stats, merged = B.bucket_stats(B.buckets(tuples)).first(), B.merge_stats(tuples).first()
    assert (merged.num_minimizers, merged.num_positions, merged.num_super_kmers) == (stats.num_buckets, stats.num_positions, len(runs))
    ranges = B.bucket_ranges(B.buckets(tuples)).orderBy("bucket_id").collect()
    assert [r.begin for r in ranges[1:]] == [r.end for r in ranges[:-1]] and ranges[-1].end == stats.num_positions
    empty = B.bucket_stats(B.buckets(tuples.limit(0)))
    assert empty.first().num_kmers == 0 and B.bucket_shares(empty).first()[0] is None and B.bucket_ranges(B.buckets(tuples.limit(0))).count() == 0


def py_lookup(strings_, k, canonical):
    first = {}
    at = 0
    for s in strings_:
        if len(s) >= k:
            for i in range(len(s) - k + 1):
                first.setdefault(s[i : i + k], at + i)
            at += len(s)

    def find(q):
        if len(q) != k or not re.fullmatch("[ACGTacgt]*", q):
            return None
        f, r = first.get(q.upper()), first.get(rc(q.upper()))
        if f is not None and (r is None or not canonical or f <= r):
            return f, 1
        return None if r is None else (r, -1)

    return find


@pytest.mark.parametrize("k", [5, 21, 31, 33, 63])
@pytest.mark.parametrize("canonical", [False, True])
def test_lookup(spark, k, canonical):
    rng = random.Random(k)
    held = [dna(rng, rng.randint(k - 2, 3 * k)) for _ in range(12)]
    held += [held[0], rc(held[1]), "A" * (k + 3), dna(rng, 1500), dna(rng, 512), dna(rng, 511 + k)]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=k, m=3, canonical=canonical))
    text = "".join(held)
    queries = [text[p : p + k] for p in range(0, len(text) - k, 3)] + [rc(text[p : p + k]).lower() for p in range(0, len(text) - k, 5)]
    queries += [dna(rng, k) for _ in range(20)] + ["", "N" * k, "A" * (k + 1), "ACG"]
    find = py_lookup(held, k, canonical)
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(queries)] + [(-1, None)], "qid long, kmer string")
    got = {r.qid: r for r in d.query(frame).collect()}
    assert len(got) == len(queries) + 1 and got[-1].found is False
    for i, q in enumerate(queries):
        want, r = find(q), got[i]
        assert (r.found, r.kmer_offset, r.orientation) == ((True, *want) if want else (False, None, None)), q
        if want:
            assert r.kmer_id == r.kmer_offset - r.string_id * (k - 1) and r.kmer_id_in_string == r.kmer_offset - r.string_begin
            assert r.string_begin <= r.kmer_offset and r.kmer_offset + k <= r.string_end
    inside = {r.qid for r in d.contains(frame).collect()}
    assert inside == {i for i, q in enumerate(queries) if find(q)}
    assert {r.qid for r in d.contains(frame, absent=True).collect()} == set(got) - inside
    assert d.check().count() == 0 and occurrences(d).agg(F.sum("count")).first()[0] == sum(max(0, len(s) - k + 1) for s in held)


@pytest.mark.parametrize("k", [15, 33])
def test_membership_by_a_sketch(spark, k):
    """Same rows as the join alone; nine of ten absent k-mers never reach it; a sketch beyond its bound is not made."""
    rng = random.Random(k)
    d = build_dictionary(seqs_of(spark, [dna(rng, 400) for _ in range(200)]), BuildConfig(k=k, m=5))
    held = [r.kmer for r in windows.kmer_windows(d.strings, k, []).limit(2000).collect()]
    asked = held + [rc(x).lower() for x in held[:300]] + [dna(rng, k) for _ in range(4000)] + ["", "N" * k, "ACG", None]
    frame = spark.createDataFrame(list(enumerate(asked)), "qid long, kmer string")
    for absent in (False, True):
        want = {r.qid for r in d.contains(frame, absent).collect()}
        assert {r.qid for r in d.contains_sketched(frame, absent).collect()} == want
        assert {r.qid for r in sketches.members_sketched(frame, d.index, k, None, absent).collect()} == want
    keys = frame.select(lookups.query_key(F.col("kmer"), k).alias("key")).filter("key IS NOT NULL").select("key" if k <= 31 else "key.*")
    maybe = keys.select(d.sketch.maybe(F.xxhash64(*keys.columns)).alias("m")).filter("m").count()
    assert 2300 <= maybe <= 2300 + 400
    assert sketches.sketch_keys(d.index, k, most_bytes=1000) is None
    assert sketches.sketch_keys(d.index.limit(0), k).blocks == 1


def test_heavy_buckets_are_exact(spark):
    """Motifs repeated so often that buckets of 200 and 300 places exist: every stored k-mer is found."""
    rng = random.Random(21)
    rows = [dna(rng, 13) + motif + dna(rng, 13) for motif, n in (("AAAAA", 200), ("CCCCC", 300)) for _ in range(n)]
    d = build_dictionary(seqs_of(spark, rows), BuildConfig(k=31, m=5))
    assert d.check().count() == 0
    reads = d.strings.select(F.col("string_id").alias("query_id"), "seq")
    fast = {(r.query_id, r.pos): r.kmer_offset for r in lookups.minimizer_join(reads, d.strings, 31, 5).collect()}
    plain = {(r.query_id, r.pos): r.kmer_offset for r in d.stream_query(reads).collect() if r.orientation == 1}
    assert fast == plain and len(fast) == 500


@pytest.mark.parametrize("k, m, canonical", [(15, 3, True), (15, 4, True), (15, 7, False), (33, 5, True)])
def test_minimizer_lookup_of_both_strands(spark, k, m, canonical):
    """Light and heavy minimizers, windows whose strands tie, repeats on both strands, N and lower case: as the plain lookup."""
    rng = random.Random(10 * k + m)
    held = [dna(rng, rng.randint(k, 90)) for _ in range(40)] + [dna(rng, 1300), "A" * 60, "ACGT" * 20]
    held += [rc(held[0]), held[1], rc(held[40])[100:400]] + [dna(rng, 12) + "AAACCC" + dna(rng, 12) for _ in range(100)]
    reads = [s if i % 2 else rc(s) for i, s in enumerate(held)] + [dna(rng, 80), held[40][:300] + "N" + held[40][301:].lower(), "", "ACG", "T" * 50]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=k, m=m, canonical=canonical))
    frame = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string")
    want = {(r.query_id, r.pos): (r.kmer_offset, r.orientation) for r in d.stream_query(frame).filter("found").collect()}
    for light in (64, 2):
        got = lookups.minimizer_lookup(frame, d.strings, k, m, canonical_mode=canonical, light=light).collect()
        assert {(r.query_id, r.pos): (r.kmer_offset, r.orientation) for r in got} == want and len(got) == len(want)


def test_minimizer_lookup_never_pairs_runs(spark):
    """Runs of one minimizer, more than a batch holds, are not joined pair by pair; the answers are those of the plain lookup."""
    rng = random.Random(8)
    held = [dna(rng, 14) + "ACGTTGCAAC" + dna(rng, 14) for _ in range(60)]
    reads = [s if i % 2 else rc(s) for i, s in enumerate(held)] + [dna(rng, 5) + s[5:] for s in held]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=15, m=5, canonical=True))
    frame = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string")
    want = sorted((r.query_id, r.pos, r.kmer_offset, r.orientation) for r in d.stream_query(frame).filter("found").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = lookups.minimizer_lookup(frame, d.strings, 15, 5)
        assert sorted(tuple(r) for r in found.collect()) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(sequence" not in plan and "minimizer" in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stretches_are_linear_and_hold_each_window_once(spark):
    rng = random.Random(3)
    rows = ["ACGTN" * 20_000, "N" * 5000, "acgtacgtacgt" + "N" + dna(rng, 3000), "NACGTACGTAN", "ACG", "", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "query_id long, seq string")
    got = sorted((r.query_id, r.offset + i, r.seq[i : i + 4]) for r in windows.stretches(frame, 4).collect() for i in range(len(r.seq) - 3))
    want = sorted((q, i, s[i : i + 4].upper()) for q, s in enumerate(rows) if s for i in range(len(s) - 3) if re.fullmatch("[ACGTacgt]{4}", s[i : i + 4]))
    assert got == want


def py_scan(read, k, find, place):
    """The scan as a state machine: extend the last hit by one base, or search."""
    counts, state = dict.fromkeys(("searches", "extensions", "invalid", "negative"), 0), None
    for i in range(len(read) - k + 1):
        q = read[i : i + k]
        hit = find(q)
        if not re.fullmatch("[ACGTacgt]*", q):
            counts["invalid"] += 1
            state = None
        elif hit is None:
            counts["negative"] += 1
            state = None
        else:
            go_on = state and hit == (state[0] + state[1], state[1]) and place(hit[0]) == place(state[0])
            counts["extensions" if go_on else "searches"] += 1
            state = hit
    return counts


@pytest.mark.parametrize("canonical", [False, True])
def test_scan_counters(spark, canonical):
    rng = random.Random(31)
    k, held = 11, []
    seen = set()
    for _ in range(30):  # a true spectrum-preserving set
        s = dna(rng, 40)
        own = [min(s[i : i + k], rc(s[i : i + k])) for i in range(30)]
        if len(set(own)) == 30 and not seen & set(own):
            held.append(s)
            seen |= set(own)
    find, place = py_lookup(held, k, canonical), lambda off: off // 40
    reads = [held[i][5:30] + held[i + 1][:20] for i in range(10)] + [rc(s) for s in held[:10]] + [held[3][:15] + "N" + held[3][16:], "acg", held[2].lower(), dna(rng, 50)]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=k, m=4, canonical=canonical))
    frame = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string")
    got = d.stats(frame).first()
    want = {c: sum(py_scan(r, k, find, place)[c] for r in reads) for c in ("searches", "extensions", "invalid", "negative")}
    assert {c: got[c] for c in want} == want and got.windows == sum(want.values())
    assert tuple(scan.scan_check(d.stream_query(frame), d.index, k, canonical).first()) == (got.windows, 0)
    assert d.stats(frame.limit(0)).first().hit_rate is None
    found = d.stream_query(frame)
    whole = sorted(map(str, scan.with_extension(found).collect()))
    for block in (1, 7, 8):  # reads in blocks of windows
        assert sorted(map(str, scan.with_extension(found, block).collect())) == whole


def py_seeded(read, held, k, find):
    """The scan that stays on the string it has found: (first window, windows, offset, orientation) of every search."""
    begins, at = [], 0
    for s in held:
        if len(s) >= k:
            begins.append((at, s))
            at += len(s)
    runs, state = [], None
    for i in range(len(read) - k + 1):
        q = read[i : i + k].upper()
        if not re.fullmatch("[ACGT]*", q):
            state = None
            continue
        if state:
            off, turn = state[0] + state[1], state[1]
            begin, s = next((b, s) for b, s in begins if b <= state[0] < b + len(s))
            stored = s[off - begin : off - begin + k] if off >= begin else ""
            if stored in (q, rc(q)):
                state, runs[-1][1] = (off, turn), runs[-1][1] + 1
                continue
        state = find(q)
        if state:
            runs.append([i, 1, *state])
    return [tuple(r) for r in runs]


@pytest.mark.parametrize("k, block, canonical", [(5, 1 << 16, False), (5, 7, True), (11, 64, False)])
def test_scans_of_repeats_follow_their_string(spark, k, block, canonical):
    """Strings made of shared pieces, in both orientations, and reads across them: runs equal the state machine's."""
    rng = random.Random(100 * k + block)
    pieces = [dna(rng, rng.randint(k, 3 * k)) for _ in range(6)] + ["A" * 30, "ACACACACACAC"]

    def made(n):
        return "".join(p if rng.random() < 0.5 else rc(p) for p in rng.choices(pieces, k=n))

    held = [made(rng.randint(1, 5)) for _ in range(14)] + [made(60), "ACG", "A" * 700]
    long_one = held[14][200:900]
    reads = [made(rng.randint(1, 6)) for _ in range(40)] + [held[14], rc(held[14]), held[3] + "N" + held[4].lower(), "A" * 1500, "", "AC", long_one[:350] + long_one[351:]]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=k, m=3, canonical=canonical))
    frame = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string")
    found = d.stream_query(frame)
    got = {}
    for r in seeds.seeded_runs(found, frame, d.strings, k, block).collect():
        got.setdefault(r.query_id, []).append((r.first_pos, r.num_kmers, r.kmer_offset, r.orientation))
    find = py_lookup(held, k, canonical)
    want = {i: py_seeded(r, held, k, find) for i, r in enumerate(reads)}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    if block > 100:
        stats = d.stats(frame).first()
        assert (stats.searches, stats.extensions) == (sum(map(len, want.values())), sum(n - 1 for v in want.values() for _, n, _, _ in v))
        assert stats.windows == stats.searches + stats.extensions + stats.invalid + stats.negative and not d.is_unique
        assert d.stats(frame.limit(0)).first().searches == 0


def test_a_long_repeat_is_followed_in_few_rounds(spark):
    """A read that follows the later of two copies: 40,000 windows whose first places are elsewhere."""
    rng = random.Random(5)
    copy, head, tail = dna(rng, 40_000), dna(rng, 300), dna(rng, 300)
    d = build_dictionary(seqs_of(spark, [copy, head + copy + tail]), BuildConfig(k=31, m=7))
    for turn, read in ((1, head + copy + tail), (-1, rc(head + copy + tail))):
        frame = spark.createDataFrame([(0, read)], "query_id long, seq string")
        n = len(read) - 30
        runs = seeds.seeded_runs(d.stream_query(frame), frame, d.strings, 31).collect()
        assert [tuple(r)[1:] for r in runs] == [(0, n, 40_000 if turn > 0 else 40_000 + n - 1, turn, 1)]


def test_positions(spark):
    d = build_dictionary(seqs_of(spark, ["ACGTACGTA", "TTTTTTT"]), BuildConfig(k=5, m=2))
    pos = spark.createDataFrame([(p,) for p in range(0, 18)], "pos long")
    got = {r.pos: (r.string_id, r.kmer) for r in d.kmer_at(pos).collect()}
    text = "ACGTACGTATTTTTTT"
    for p in range(16):
        sid = 0 if p < 9 else 1
        assert got[p] == (sid, text[p : p + 5] if p + 5 <= (9 if sid == 0 else 16) else None)
    assert got[16] == got[17] == (None, None)


def test_places_in_strings_of_several_chunks(spark):
    rng = random.Random(53)
    held = [dna(rng, n) for n in (511, 512, 513, 526, 527, 528, 1100, 20)]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=15, m=4))
    wanted = spark.createDataFrame([(i, p) for i, s in enumerate(held) for p in range(-1, len(s) + 1)] + [(99, 0), (None, 0)], "string_id long, pos long")
    got = {(r.string_id, r.pos): r.kmer for r in d.access(wanted).collect()}
    want = {(i, p): s[p : p + 15] if 0 <= p <= len(s) - 15 else None for i, s in enumerate(held) for p in range(-1, len(s) + 1)}
    assert got == {**want, (99, 0): None, (None, 0): None}
    begin = {r.string_id: r.string_begin for r in d.strings.collect()}
    at = d.kmer_at(spark.range(sum(map(len, held)) + 3).select(F.col("id").alias("pos"))).collect()
    assert all(r.kmer == (want[r.string_id, r.pos - begin[r.string_id]] if r.string_id is not None else None) for r in at)
    assert sum(r.kmer is not None for r in at) == sum(len(s) - 14 for s in held)


def test_save_and_load(spark, tmp_path):
    d = build_dictionary(seqs_of(spark, ["ACGTACGTAGG", "TTTACTTTT"]), BuildConfig(k=5, m=2, seed=7))
    path = str(tmp_path / "dict")
    d.save(path)
    back = load_dictionary(spark, path)
    assert back.config == d.config and back.check().count() == 0
    assert sorted(map(tuple, back.super_kmers.collect())) == sorted(map(tuple, d.super_kmers.collect()))
    with pytest.raises(Exception, match="exists"):
        d.save(path)
    (tmp_path / "other" / "meta").mkdir(parents=True)
    (tmp_path / "other" / "meta" / "m.txt").write_text('{"format": "strandloom-dictionary", "version": 99}')
    with pytest.raises(DictionaryFormatError):
        load_dictionary(spark, str(tmp_path / "other"))


@pytest.mark.parametrize("k", [15, 63])
def test_a_loaded_dictionary_is_not_shuffled_again(spark, tmp_path, k):
    """Only the queries are, into the index's buckets; rows are those of the dictionary as built."""
    rng = random.Random(k)
    held = [dna(rng, 200) for _ in range(20)]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=k, m=5))
    path = str(tmp_path / "dict")
    d.save(path, partitions=8)
    asked = spark.createDataFrame([(s[i : i + k] if i % 3 else rc(s[i : i + k]),) for s in [*held, dna(rng, 200)] for i in range(0, 130, 7)], "kmer string")
    back = load_dictionary(spark, path)
    for conf, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(conf, value)
    try:
        answers = back.query(asked)
        plan = answers._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, answers.collect())) == sorted(map(str, d.query(asked).collect()))
        inside = back.contains(asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for text in (plan, inside):
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(41)
    held = [dna(rng, 60) for _ in range(10)]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=15, m=5))
    index = d.index.persist()
    reads = [(i, f"2024-01-01 00:{i:02d}:00", held[i % 10][i % 7 : 50]) for i in range(30)]
    frame = spark.createDataFrame(reads, "query_id long, t string, seq string").select("query_id", F.to_timestamp("t").alias("ts"), "seq")
    frame.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), frame.schema, files_per_trigger=2)
    run_once(stream_scan(stream, index, 15), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = sorted(map(str, scan.scan_lookup(frame, index, 15).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*scan.scan_lookup(frame, index, 15).columns).collect())) == want
    assert window_counts(scan.scan_lookup(frame, index, 15)).agg(F.sum("found")).first()[0] == len(want)


def chunk_files(spark, folder, waves):
    """One file, and so one micro-batch, per wave of (query_id, start, seq, minute)."""
    for wave in waves:
        rows = spark.createDataFrame(wave, "query_id long, start long, seq string, t long")
        rows.select("query_id", "start", "seq", F.timestamp_seconds(1_700_000_000 + F.col("t") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def run_chunks(spark, tmp_path, index, k, waves, canonical=False):
    """The rows that a stream over the waves gives, and what its state operators told of each micro-batch."""
    chunk_files(spark, str(tmp_path / "in"), waves)
    stream = read_stream(spark, str(tmp_path / "in"), "query_id long, start long, seq string, ts timestamp", files_per_trigger=1)
    out = chunk_scan(stream, index, k, canonical)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), [p.stateOperators for p in query.recentProgress]


@pytest.mark.parametrize("canonical", [False, True])
def test_chunked_reads_equal_the_batch_scan(spark, tmp_path, canonical):
    """Chunks of any size, out of order, repeated, overlapping, with N and lower case: windows, hits and extensions of the whole reads."""
    rng = random.Random(43)
    held = [dna(rng, 60) for _ in range(6)]
    d = build_dictionary(seqs_of(spark, held), BuildConfig(k=15, m=5, canonical=canonical))
    index = d.index.persist()
    reads = [held[i % 6] if i % 3 else rc(held[i % 6]) for i in range(9)] + [held[1][:30] + "N" + held[1][31:], held[2].lower(), held[3][:40] + held[4], dna(rng, 50), "ACG", ""]
    waves = [[], [], [], []]
    for q, read in enumerate(reads):
        at = 0
        while at < len(read):
            n, start = rng.randint(1, 25), max(0, at - rng.choice([0, 0, 3]))
            piece = (q, start, read[start : at + n], 0)
            waves[rng.randrange(4)].append(piece)
            if rng.random() < 0.2:
                waves[rng.randrange(4)].append(piece)
            at += n
    got, _ = run_chunks(spark, tmp_path, index, 15, waves, canonical)
    frame = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string")
    want = scan.with_extension(d.stream_query(frame))
    columns = ["query_id", "pos", "kmer", "valid", "found", "kmer_offset", "orientation", "string_id", "is_extension"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.withColumn("pos", F.col("pos").cast("long")).select(*columns).collect()))


def test_state_of_finished_reads_ends_and_late_chunks_have_a_fate(spark, tmp_path):
    rng = random.Random(44)
    held = [dna(rng, 60) for _ in range(4)]
    index = build_dictionary(seqs_of(spark, held), BuildConfig(k=15, m=5)).index.persist()
    waves = [
        [(0, 0, held[0][:20], 0), (1, 0, held[1][:20], 0)],
        [(0, 20, held[0][20:], 5), (1, 30, held[1][30:], 5), (2, 0, held[2], 100)],  # 20 to 29 of read 1 never come
        [(3, 0, held[3], 101)],
        [(0, 20, held[0][20:], 5), (3, 0, held[3], 300)],  # behind the watermark: dropped; a read seen again
        [(3, 0, held[3], 302)],
        [(2, 20, held[2][20:], 295)],  # after the end of read 2, before the watermark: alone
        [(9, 0, "ACGT", 2000)],
    ]
    got, progress = run_chunks(spark, tmp_path, index, 15, waves)
    places = {}
    for r in got.collect():
        assert r.found and r.kmer_offset == 60 * r.query_id + r.pos
        places.setdefault(r.query_id, []).append((r.pos, r.is_extension))
    assert {q: sorted(v) for q, v in places.items()} == {
        0: [(p, p > 0) for p in range(46)],
        1: [(p, p not in (0, 30)) for p in [*range(6), *range(30, 46)]],
        2: sorted([(p, p > 0) for p in range(46)] + [(p, p > 20) for p in range(20, 46)]),
        3: [(p, p > 0) for p in range(46)],
    }
    assert sum(o.numRowsDroppedByWatermark for ops in progress for o in ops) == 1
    assert [o.numRowsRemoved > 0 for o in progress[-1]] == [True, True] and all(o.numRowsTotal <= 3 for o in progress[-1])  # only read 9 is left


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(47)
    d = build_dictionary(seqs_of(spark, [dna(rng, 50) for _ in range(20)]).repartition(int(partitions)), BuildConfig(k=9, m=3))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, d.strings.collect())), tuple(B.bucket_stats(d.buckets).first())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    if not hasattr(test_results_do_not_depend_on_partitions, "seen"):
        test_results_do_not_depend_on_partitions.seen = got
    assert got == test_results_do_not_depend_on_partitions.seen
