"""Windows over sequences: k-mers, minimizers and super-k-mers, all map-side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from strandloom.functions import is_dna, mix31, order_key, reverse_order_key
from strandloom.functions.bases import BASES
from strandloom.functions.kmers import LONG_BASES


#: Windows of one chunk of a sequence.
CHUNK = 512


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all shuffle partitions: a few rows are about to become very many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    A plain projection may be folded into the lambdas that read it and then run once per
    element; the optimizer does not fold a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunks(seqs: DataFrame, k: int, keep: list[str], left: int = 0, right: int = 0, short: bool = False, tasks: int | None = None) -> DataFrame:
    """The kept columns, ``_c`` and ``_text``: consecutive chunks of ``CHUNK`` windows of k letters each,
    with ``left`` letters more before (but for the first) and ``right`` more after.  With ``short`` also the rest of a
    sequence that holds no window.

    Taking a piece of a string costs its distance from the start, and arrays over a whole
    chromosome are slow to carry, so windows are cut from short chunks: the work is linear in the
    sequence.  Chunks are dealt over all shuffle partitions (or ``tasks``) before anything is made of them, so
    one long sequence keeps all tasks busy; only the cutting is one task a sequence.
    """
    # Held before the filter, which would otherwise be pushed below what makes the sequence and make it twice.
    seqs = _held(seqs.select(*keep, F.col("seq").alias("_seq")), "seq", F.col("_seq"))
    rows = _held(seqs.filter(F.length("seq") >= k).select(*keep, "seq"), "_parts", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).drop("seq")

    def joined(x: Column, i: Column) -> Column:
        after = F.coalesce(F.substring(F.get("_parts", i + 1), 1, k - 1 + right), F.lit(""))
        before = [F.coalesce(F.right(F.get("_parts", i - 1), F.lit(left)), F.lit(""))] if left else []
        return F.concat(*before, x, after)

    cut = rows.select(*keep, F.posexplode(F.transform("_parts", joined)).alias("_c", "_text"))
    cut = cut if short else cut.filter(F.length("_text") >= k)
    return cut.repartition(tasks or int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_c", *(keep or ["_text"]))


def stretches(reads: DataFrame, k: int) -> DataFrame:
    """Pieces of letters ACGT (in upper case) that hold each window of k such letters once: the columns of the reads, ``seq``
    being the piece, and ``offset``.

    Runs of such letters are cut further at chunks, so the work is linear in a sequence and no piece is long.
    """
    keep = [c for c in reads.columns if c != "seq"]
    rows = chunks(reads.withColumn("seq", F.upper("seq")), k, keep)
    parts = F.regexp_extract_all("_text", F.lit("[ACGT]+|[^ACGT]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,seq:string>>").alias("held"))
    walked = F.aggregate(parts, start, lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["held"], F.array(F.struct(s["at"].alias("offset"), x.alias("seq")))).alias("held")))
    whole = F.array(F.struct(F.lit(0).alias("offset"), F.col("_text").alias("seq")))
    found = F.when(is_dna(F.col("_text")), whole).otherwise(F.filter(walked["held"], lambda p: p["seq"].rlike("^[ACGT]") & (F.length(p["seq"]) >= k)))
    cut = rows.select(*keep, "_c", F.explode(found).alias("_p"))
    return cut.select(*keep, F.col("_p.seq").alias("seq"), (F.col("_c") * CHUNK + F.col("_p.offset")).cast("int").alias("offset"))


#: Chunks of one Arrow batch of windows, so that a batch is a few MB.
BATCH = 128
#: Two-bit codes of letters in either case; 4: another letter.
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(f"{BASES}{BASES.lower()}".encode(), np.uint8)] = [0, 1, 2, 3] * 2


def _packed(codes: np.ndarray, n: int, turned: bool) -> np.ndarray:
    """Of every place the integer of the n codes from there, the first or, if ``turned``, the last in the lowest bits."""
    found, done, power, width = None, 0, codes, 1
    while True:
        if n & width:
            rest = power[done:]
            if found is None:
                found = power
            else:
                found = found[: len(rest)] << 2 * width | rest[: len(found)] if turned else found[: len(rest)] | rest[: len(found)] << 2 * done
            done += width
        if done == n:
            return found
        power = power[:-width] << 2 * width | power[width:] if turned else power[:-width] | power[width:] << 2 * width
        width *= 2


def _limbs(codes: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of every window its canonical form in limbs of at most 31 bases, lowest first, and whether it is itself that form."""
    count, fwd, rev = len(codes) - k + 1, [], []
    for a in range(0, k, LONG_BASES):
        n = min(LONG_BASES, k - a)
        fwd.append(_packed(codes, n, False)[a : a + count])
        rev.append(_packed(codes ^ 2, n, True)[k - a - n : k - a - n + count])  # the complement's code
    own, same = np.zeros(count, bool), np.ones(count, bool)
    for f, r in zip(reversed(fwd), reversed(rev)):
        own |= same & (f < r)
        same &= f == r
    return [np.where(own, f, r) for f, r in zip(fwd, rev)], own


def _packed_at(codes: np.ndarray, n: int, start: np.ndarray, turned: bool) -> np.ndarray:
    """As ``_packed`` for at most 31 codes, from the places ``start`` on only: shorter packs are made everywhere, in as few bytes as hold them."""
    power, width = {1: codes.astype(np.uint8)}, 1
    while 2 * width <= n:
        x = power[width].astype((np.uint8, np.uint8, np.uint16, np.uint32)[width.bit_length() - 1])
        power[2 * width] = x[:-width] << 2 * width | x[width:] if turned else x[:-width] | x[width:] << 2 * width
        width *= 2
    found, done = np.zeros(len(start), np.int64), 0
    while done < n:
        if n - done >= width:
            part = power[width][start + done].astype(np.int64)
            found = found << 2 * width | part if turned else found | part << 2 * done
            done += width
        width //= 2
    return found


def _limbs_at(codes: np.ndarray, k: int, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``_limbs``, of the windows from the places ``start`` on only."""
    parts = [(a, min(LONG_BASES, k - a)) for a in range(0, k, LONG_BASES)]
    fwd = [_packed_at(codes, n, start + a, False) for a, n in parts]
    rev = [_packed_at(codes ^ 2, n, start + (k - a - n), True) for a, n in parts]  # the complement's code
    own, same = np.zeros(len(start), bool), np.ones(len(start), bool)
    for f, r in zip(reversed(fwd), reversed(rev)):
        own |= same & (f < r)
        same &= f == r
    return [np.where(own, f, r) for f, r in zip(fwd, rev)], own


def _texts(letters: np.ndarray) -> pa.Array:
    """Strings of one length from rows of bytes."""
    n, k = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def _letters(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place on."""
    return np.lib.stride_tricks.sliding_window_view(data, k)[start] if len(start) else np.zeros((0, k), np.uint8)


def _standing(data: np.ndarray, at: np.ndarray, others: list[str] | None, row: np.ndarray, place: np.ndarray, k: int) -> pa.Array:
    """The k letters from each place of strings (as ``_letters_of`` gives them) on."""
    if others:
        return pa.array([others[r][p : p + k] for r, p in zip(row.tolist(), place.tolist())], pa.string())
    return _texts(_letters(data, at[row] + place, k))


def _cut(rows: DataFrame, keep: list[str], k: int, give: dict[str, str], once: bool = False, size: int = BATCH) -> DataFrame:
    """The kept columns and ``pos`` of every window of chunks (``_c``, ``_text``), and by the names ``give`` tells: ``kmer`` as it stands,
    ``canonical`` (its canonical form's letters), ``valid`` (k letters ACGT in either case), the join ``key`` of its canonical form, null if not
    valid, and ``own``, whether it is itself that form.

    Letters are packed by doubling the packed length, some array operations a chunk instead of some string functions
    a window; batches hold ``size`` chunks.  With ``once`` a batch gives one window of each key.  Binary ``_text`` is folded.
    """
    folded = isinstance(rows.schema["_text"].dataType, BinaryType)
    limbs = range(-(-k // LONG_BASES))
    key = LongType() if k <= LONG_BASES else StructType([StructField(f"l{i}", LongType()) for i in limbs])
    types = {"kmer": StringType(), "canonical": StringType(), "valid": BooleanType(), "key": key, "own": BooleanType()}
    schema = StructType([*(rows.schema[c] for c in keep), StructField("pos", IntegerType()), *(StructField(name, types[what]) for what, name in give.items())])

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("_text")
        data, at, others = _letters_of(unfold(text) if folded else text)
        row, place = _within(np.clip(np.diff(at) - k + 1, 0, CHUNK))
        start, codes = at[row] + place, CODES[data]
        made = {}
        if "valid" in give or "key" in give:
            wrong = np.r_[0, np.cumsum(codes > 3)]
            valid = wrong[start + k] == wrong[start]
            made["valid"] = pa.array(valid)
        if "key" in give or "canonical" in give:
            packed, own = _limbs((codes & 3).astype(np.int64), k) if len(codes) >= k else ([np.zeros(0, np.int64) for _ in limbs], np.zeros(0, bool))
            made["own"] = pa.array(own[start])
        if "key" in give:
            none = None if valid.all() else ~valid
            parts = [pa.array(x[start], mask=none if k <= LONG_BASES else None) for x in packed]
            made["key"] = parts[0] if k <= LONG_BASES else pa.StructArray.from_arrays(parts, [f"l{i}" for i in limbs], mask=None if none is None else pa.array(none))
        if "kmer" in give:
            made["kmer"] = _standing(data, at, others, row, place, k)
        if "canonical" in give:
            last, turned = len(data) - k - start, np.frombuffer(data.tobytes()[::-1].translate(bytes.maketrans(b"ACGT", b"TGCA")), np.uint8)
            made["canonical"] = _texts(np.where(own[start][:, None], _letters(data, start, k), _letters(turned, last, k)))
        pos = np.asarray(batch.column("_c"))[row] * CHUNK + place
        kept = [batch.column(c).take(pa.array(row)) for c in keep]
        found = pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int32()), *(made[what] for what in give)], [*keep, "pos", *give.values()])
        if not once or not len(row):
            return found
        order = np.lexsort([x[start] for x in packed])
        new = np.any([np.diff(x[start][order], prepend=-1) != 0 for x in packed], axis=0)  # packed letters are never negative
        return found.take(pa.array(np.sort(order[new])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                yield windows(batch.slice(i, size))

    return rows.select(*keep, "_c", "_text").mapInArrow(cut, schema)


def kmer_windows(seqs: DataFrame, k: int, keep: list[str] | None = None) -> DataFrame:
    """Every window of k letters: the kept columns, ``pos`` from 0, and ``kmer`` as it stands."""
    keep = [c for c in seqs.columns if c != "seq"] if keep is None else keep
    return _cut(chunks(seqs, k, keep), keep, k, {"kmer": "kmer"})


def canonical_windows(seqs: DataFrame, k: int) -> DataFrame:
    """Every window of sequences of ACGT: their columns, ``pos``, and ``canonical``, the letters of its canonical form."""
    keep = [c for c in seqs.columns if c != "seq"]
    return _cut(chunks(seqs, k, keep), keep, k, {"canonical": "canonical"})


def keyed_windows(seqs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """Every window of sequences of ACGT: the kept columns, ``pos``, the join ``key`` of its canonical
    form, and ``own``: whether it is itself that form."""
    return _cut(chunks(seqs, k, keep), keep, k, {"key": "key", "own": "own"})


def keyed_pieces(pieces: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """As ``keyed_windows`` for very many short sequences, of one chunk at most each: they stay in the tasks where they are."""
    return _cut(pieces.select(*keep, F.lit(0).alias("_c"), F.col("seq").alias("_text")), keep, k, {"key": "key", "own": "own"}, size=16 * BATCH)


def window_keys(seqs: DataFrame, k: int, tasks: int) -> DataFrame:
    """``key`` of the windows of sequences of ACGT, made by so many tasks, each once a batch: a frequent one is no hot key, and no task holds a map of keys."""
    return _cut(chunks(seqs, k, [], tasks=tasks), [], k, {"key": "key"}, once=True).select("key")


def query_windows(seqs: DataFrame, k: int) -> DataFrame:
    """Every window of sequences of any letters: their columns, ``pos``, ``kmer`` as it stands, ``valid`` (k
    letters ACGT in either case), and as in ``keyed_windows`` ``_key``, null if not valid, and ``_own``."""
    keep = [c for c in seqs.columns if c != "seq"]
    return _cut(chunks(seqs, k, keep), keep, k, {"kmer": "kmer", "valid": "valid", "key": "_key", "own": "_own"})


#: Above the place of an m-mer in a chunk, so that hash and place are one long.
PLACES = 1 << 12


def _values(order: str, m: int, strand: int) -> Column:
    """The packed m-mers of one strand, place by place on the forward one, from the strand's order key."""
    n = F.length(order)
    return F.transform(F.sequence(F.lit(0), n - m), lambda i: F.conv(F.substring(F.col(order), (n - i - m + 1) if strand > 0 else i + 1, F.lit(m)), 4, 10).cast("bigint"))


def _ranks(values: str, seed: int, strand: int) -> Column:
    """Longs of which the least belongs to the m-mer of the least hash, the leftmost of ties.

    On the reverse strand the leftmost of ties is the one that stands last here.
    """
    return F.transform(F.col(values), lambda v, i: mix31(v, seed) * PLACES + (i if strand > 0 else PLACES - 1 - i))


def _with_minimizers(rows: DataFrame, k: int, m: int, canonical: bool, seed: int) -> DataFrame:
    """Adds ``mins``: of every window of ``_text`` the struct (v, i), its minimizer and the minimizer's place.

    The m-mer of the least hash wins, the leftmost of ties.  In canonical mode the strand of
    the lesser *value* wins, the forward one of ties; the place is always that on this strand.
    The m-mers of a chunk are packed and hashed once and windows take slices, so nothing is shuffled.
    """
    rows = _held(rows, "_fo", order_key(F.col("_text")))
    rows = _held(rows, "_fv", _values("_fo", m, 1))
    rows = _held(rows, "_f", _ranks("_fv", seed, 1)).drop("_fo")
    if canonical:
        rows = _held(rows, "_ro", reverse_order_key(F.col("_text")))
        rows = _held(rows, "_rv", _values("_ro", m, -1))
        rows = _held(rows, "_r", _ranks("_rv", seed, -1)).drop("_ro")
    span = k - m + 1
    rows = _held(rows, "_fi", F.transform(F.sequence(F.lit(0), F.length("_text") - k), lambda p: F.array_min(F.slice("_f", p + 1, F.lit(span))).bitwiseAND(F.lit(PLACES - 1)).cast("int")))
    if canonical:
        least = lambda p: F.lit(PLACES - 1) - F.array_min(F.slice("_r", p + 1, F.lit(span))).bitwiseAND(F.lit(PLACES - 1)).cast("int")
        rows = _held(rows, "_ri", F.transform(F.sequence(F.lit(0), F.length("_text") - k), least))

    def one(i: Column, p: Column) -> Column:
        f = F.get("_fv", i)
        if not canonical:
            return F.struct(f.alias("v"), i.alias("i"))
        j = F.get("_ri", p)
        r = F.get("_rv", j)
        return F.struct(F.least(f, r).alias("v"), F.when(r < f, j).otherwise(i).alias("i"))

    return _held(rows, "mins", F.transform("_fi", one)).drop("_f", "_fv", "_fi", *(["_r", "_rv", "_ri"] if canonical else []))


def minimizers(seqs: DataFrame, k: int, m: int, canonical: bool = False, seed: int = 1) -> DataFrame:
    """One row per window: ``pos, minimizer, pos_in_kmer`` and the columns of ``seqs`` but its text."""
    keep = [c for c in seqs.columns if c != "seq"]
    rows = _with_minimizers(chunks(seqs, k, keep), k, m, canonical, seed).select(*keep, "_c", F.posexplode("mins").alias("_p", "_m"))
    return rows.select(*keep, (F.col("_c") * CHUNK + F.col("_p")).alias("pos"), F.col("_m.v").alias("minimizer"), (F.col("_m.i") - F.col("_p")).cast("int").alias("pos_in_kmer"))


def _least(ranks: np.ndarray, span: int) -> np.ndarray:
    """The least of ``span`` neighbours from every place on, by doubling."""
    found, width = ranks, 1
    while 2 * width <= span:
        found, width = np.minimum(found[:-width], found[width:]), 2 * width
    count = len(ranks) - span + 1
    return np.minimum(found[:count], found[span - width : span - width + count])


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """``mix31`` of packed m-mers."""
    return (values ^ np.int64(1431655765 * seed % (1 << 62))) % 2147483647 * 48271 % 2147483647


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins (and the last ends)."""
    text = text.cast(pa.string())
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _letters_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str] | None]:
    """As ``_bytes_of``, a byte for each letter; and the strings, if some letter has several bytes."""
    data, at = _bytes_of(text)
    if not len(data) or data.max() < 128:
        return data, at, None
    others = text.to_pylist()
    return np.frombuffer("".join(others).encode("ascii", "replace"), np.uint8), np.cumsum([0, *map(len, others)]), others


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place in its row of every item, if row i holds ``counts[i]`` of them."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


#: The code of an upper-case letter; 4: another byte.  And the four letters that a byte stands for.
UPPER = np.full(256, 4, np.uint8)
UPPER[np.frombuffer(BASES.encode(), np.uint8)] = range(4)
FOUR = np.frombuffer(BASES.encode(), np.uint8)[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3]
#: The first byte of a folded string whose letters are kept as they stand.
PLAIN = 4


def fold(texts: pa.Array) -> pa.Array:
    """Strings as binary: those of ACGT alone with four letters a byte, all others as they stand; the first byte tells which, and how
    many letters the last byte holds."""
    data, at = _bytes_of(texts)
    n, codes = np.diff(at), UPPER[data]
    plain = np.diff(np.r_[0, np.cumsum(codes > 3)][at]) > 0
    width = -(-n // 4)
    row, j = _within(n)
    filled = np.zeros(4 * int(width.sum()), np.uint8)
    filled[4 * (np.cumsum(width) - width)[row] + j] = codes & 3
    packed = filled[0::4] | filled[1::4] << 2 | filled[2::4] << 4 | filled[3::4] << 6
    size = np.where(plain, n, width)
    edges = np.r_[0, np.cumsum(size + 1)]
    out = np.empty(edges[-1], np.uint8)
    out[edges[:-1]] = np.where(plain, PLAIN, n & 3)
    row, j = _within(width)
    mine = ~plain[row]
    out[(edges[row] + 1 + j)[mine]] = packed[mine]
    for i in np.flatnonzero(plain).tolist():
        out[edges[i] + 1 : edges[i + 1]] = data[at[i] : at[i + 1]]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(out)])


def unfold(folded: pa.Array) -> pa.Array:
    """The strings that ``fold`` made binary."""
    folded = folded.cast(pa.binary())
    at = np.frombuffer(folded.buffers()[1], np.int32)[folded.offset : folded.offset + len(folded) + 1].astype(np.int64)
    data = np.frombuffer(folded.buffers()[2] or b"", np.uint8)
    tag, size = data[at[:-1]], np.diff(at) - 1
    plain = tag == PLAIN
    width = np.where(plain, 0, size)
    n = 4 * width - (-tag.astype(np.int64) & 3) * ~plain
    row, j = _within(width)
    letters = FOUR[data[at[row] + 1 + j]].ravel()
    row, j = _within(n)
    edges = np.r_[0, np.cumsum(n)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(n), pa.py_buffer(edges), pa.py_buffer(letters[4 * (np.cumsum(width) - width)[row] + j]))
    if not plain.any():
        return found
    texts = found.to_pylist()
    for i in np.flatnonzero(plain).tolist():
        texts[i] = data[at[i] + 1 : at[i + 1]].tobytes().decode()
    return pa.array(texts, pa.string())


def piece_windows(pieces: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of every window of short strings of ACGT: its string, its place there, its canonical form in limbs, and whether it is itself that form.

    Windows of other letters are counted too, and have any form.
    """
    data, at, _ = _letters_of(pieces)
    row, place = _within(np.clip(np.diff(at) - k + 1, 0, None))
    limbs, own = _limbs_at(CODES[data] & 3, k, at[row] + place)
    return row, place, limbs, own


def piece_kmers(pieces: pa.Array, row: np.ndarray, place: np.ndarray, k: int) -> pa.Array:
    """The k letters from each place of short strings on, as they stand."""
    data, at, others = _letters_of(pieces)
    return _standing(data, at, others, row, place, k)


#: Most windows of one run, so that a batch of runs is a few MB whatever its letters are.
RUN = 64


def _stirred(values: np.ndarray) -> np.ndarray:
    """A 62-bit hash of packed letters."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(2)).astype(np.int64)


def window_runs(seqs: DataFrame, k: int, keep: list[str], folded: bool = False) -> DataFrame:
    """The windows of sequences of any letters as runs of neighbours that are dealt together: the kept columns, ``_at``, the place of the
    run's first window, ``_minimizer``, ``_size``, its windows, and ``_piece``, its letters as they stand.

    ``_minimizer`` is the least hash of the canonical forms of a window's m-mers, so it depends on the window's canonical k-mer
    alone, and whoever deals by it brings equal k-mers of both strands together.  It is negative for a window with
    letters other than ACGT (in either case), which equals no k-mer.  ``folded`` letters are binary, as ``fold`` makes them.
    """
    return chunk_runs(chunks(seqs, k, keep), k, keep, folded)


def chunk_runs(rows: DataFrame, k: int, keep: list[str], folded: bool = False) -> DataFrame:
    """As ``window_runs``, of the ``chunks`` of sequences."""
    m = min(k // 2 + 1, 16)
    fields = [StructField("_at", IntegerType()), StructField("_minimizer", LongType()), StructField("_size", IntegerType()), StructField("_piece", BinaryType() if folded else StringType())]

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at, others = _letters_of(batch.column("_text"))
        row, place = _within(np.clip(np.diff(at) - k + 1, 0, CHUNK))
        least, new = np.zeros(0, np.int64), np.ones(len(row), bool)
        if len(row):
            codes, start = CODES[data], at[row] + place
            wrong = np.r_[0, np.cumsum(codes > 3)]
            codes, mers = codes & 3, np.arange(len(codes) - m + 1)
            least = _least(_stirred(np.minimum(_packed_at(codes, m, mers, False), _packed_at(codes ^ 2, m, mers, True))), k - m + 1)[start]
            least = np.where(wrong[start + k] == wrong[start], least, ~(least ^ row))  # by rows too, since nothing is to meet there
            new[1:] = (place[1:] % RUN == 0) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(row)))
        own, p, length = row[first], place[first], size + k - 1
        if others:
            piece = pa.array([others[r][i : i + n] for r, i, n in zip(own.tolist(), p.tolist(), length.tolist())], pa.string())
        else:
            r, j = _within(length)
            edges = np.append(0, np.cumsum(length)).astype(np.int32)
            piece = pa.StringArray.from_buffers(len(own), pa.py_buffer(edges), pa.py_buffer(data[(at[own] + p)[r] + j]))
        places = np.asarray(batch.column("_c")).astype(np.int64)[own] * CHUNK + p
        made = [pa.array(places, pa.int32()), pa.array(least[first]), pa.array(size, pa.int32()), fold(piece) if folded else piece]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in keep), *made], [*keep, *(f.name for f in fields)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                yield runs(batch.slice(a, BATCH))

    return rows.select(*keep, "_c", "_text").mapInArrow(cut, StructType([*(rows.schema[c] for c in keep), *fields]))


def query_pieces(pieces: DataFrame, k: int, keep: list[str], give: dict[str, str] | None = None) -> DataFrame:
    """As ``query_windows`` (or what ``give`` tells) for very many short sequences, of one chunk at most each: they stay in the tasks where they are."""
    rows = pieces.select(*keep, F.lit(0).alias("_c"), F.col("seq").alias("_text"))
    return _cut(rows, keep, k, give or {"kmer": "kmer", "valid": "valid", "key": "_key", "own": "_own"}, size=16 * BATCH)


def super_kmers(strings: DataFrame, k: int, m: int, canonical: bool = False, seed: int = 1, piece: bool = False, ties: bool = False) -> DataFrame:
    """Runs of neighbouring windows that share a minimizer at one place.

    ``string_id, first_pos, minimizer, pos_in_seq`` (in the whole set), ``pos_in_kmer`` (of the
    first window) and ``num_kmers``; with ``piece`` also the run's letters; in canonical mode with ``ties`` runs are cut
    where ``tie`` changes: whether the minimizers of both strands have one value (then the place depends on the strand read).  A run has at most
    k - m + 1 windows, so a chunk that sees one window before and that many after its own
    knows each of its runs whole.

    Minimizers are as in ``_with_minimizers``, found by some array operations for ``BATCH`` chunks at once.
    """
    rows = chunks(strings, k, ["string_id", "string_begin"], left=1, right=k - m + 1)
    fields = [StructField("first_pos", IntegerType()), StructField("minimizer", LongType()), StructField("pos_in_seq", LongType()), StructField("pos_in_kmer", IntegerType()), StructField("num_kmers", IntegerType())]
    fields += [StructField("piece", StringType())] if piece else []
    fields += [StructField("tie", BooleanType())] if ties else []
    low = np.int64((1 << 32) - 1)

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = _bytes_of(batch.column("_text"))
        counts = np.clip(np.diff(at) - k + 1, 0, None)
        row, p = _within(counts)
        none = np.zeros(0, np.int64)
        value, place, tie, new = none, none, np.zeros(0, bool), np.zeros(0, bool)
        if len(row):
            codes = (CODES[data] & 3).astype(np.int64)
            start, index = at[row] + p, np.arange(len(data) - m + 1)
            forward = _packed(codes, m, False)
            # Hash and place are one long: the leftmost of ties is the least one.
            at_forward = (_least(_mixed(forward, seed) << 32 | index, k - m + 1) & low)[start]
            value, place, tie = forward[at_forward], at_forward, np.zeros(len(row), bool)
            if canonical:
                turned = _packed(codes ^ 2, m, True)
                at_turned = low - (_least(_mixed(turned, seed) << 32 | low - index, k - m + 1) & low)[start]
                other = turned[at_turned]
                place, tie = np.where(other < value, at_turned, place), (other == value) & ties
                value = np.minimum(value, other)
            new = np.ones(len(row), bool)
            new[1:] = (p[1:] == 0) | (value[1:] != value[:-1]) | (place[1:] != place[:-1]) | (tie[1:] != tie[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(row)))
        number = np.asarray(batch.column("_c")).astype(np.int64)
        left = (number > 0).astype(np.int64)[row[first]]
        kept = (p[first] >= left) & (p[first] < left + CHUNK)
        first, size, left = first[kept], size[kept], left[kept]
        own, p0, i = row[first], p[first], place[first] - at[row[first]]
        base = number[own] * CHUNK - left
        begin = np.asarray(batch.column("string_begin")).astype(np.int64)[own]
        columns = [
            batch.column("string_id").take(pa.array(own)), pa.array(base + p0, pa.int32()), pa.array(value[first]), pa.array(begin + base + i),
            pa.array(i - p0, pa.int32()), pa.array(size, pa.int32()),
        ]
        if piece:
            length = size + k - 1
            r, j = _within(length)
            letters = data[(at[own] + p0)[r] + j]
            edges = np.append(0, np.cumsum(length)).astype(np.int32)
            columns.append(pa.StringArray.from_buffers(len(own), pa.py_buffer(edges), pa.py_buffer(letters)))
        if ties:
            columns.append(pa.array(tie[first]))
        return pa.RecordBatch.from_arrays(columns, ["string_id", *(f.name for f in fields)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                yield runs(batch.slice(a, BATCH))

    return rows.select("string_id", "string_begin", "_c", "_text").mapInArrow(cut, StructType([rows.schema["string_id"], *fields]))
