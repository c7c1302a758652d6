"""The string set: dense ids and running offsets, and access by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import is_dna
from strandloom.operators.windows import CHUNK, _held, chunks
from strandloom.staging import not_broadcast

#: Rows of one slice of the running offsets.
SLICE = 1 << 12


def string_set(seqs: DataFrame, k: int, on_invalid: str = "error", order: str = "id") -> DataFrame:
    """``string_id, string_begin, string_end, seq`` (and further columns) of sequences of at least k bases.

    Ids are dense from 0 in the order of the integer column ``order``; shorter sequences take none.
    Offsets are three-level prefix sums: within slices of ``SLICE`` values of the order column, over the slices of
    a group, and over the groups, of which there are at most 2**24 whatever the values are.
    ``on_invalid='split'`` cuts sequences at letters other than ACGT instead of failing.
    """
    # Held, or the filter on lengths is pushed below what makes the sequences, which then run once for each mention of them.
    seqs = _held(seqs.withColumnRenamed("seq", "_seq"), "seq", F.col("_seq")).drop("_seq")
    seq = F.upper(F.col("seq"))
    wrong = F.raise_error(F.concat(F.lit("a sequence holds letters other than ACGT: "), F.substring("seq", 1, 60))).cast("string")
    extra = [c for c in seqs.columns if c not in ("seq", order, "string_id", "string_begin", "string_end")]
    if on_invalid == "error":
        rows = seqs.select(F.col(order).cast("bigint").alias("_ord"), F.lit(0).alias("_part"), F.when(is_dna(F.col("seq")), seq).otherwise(F.when(F.col("seq").isNotNull(), wrong)).alias("seq"), *extra)
    else:
        rows = seqs.select(F.col(order).cast("bigint").alias("_ord"), F.posexplode(F.split(seq, "[^ACGT]+")).alias("_part", "seq"), *extra)
    rows = _held(rows.withColumnRenamed("seq", "_seq"), "seq", F.col("_seq")).drop("_seq")
    return _placed(rows.filter(F.length("seq") >= k).withColumn("_len", F.length("seq").cast("bigint")), ["seq", *extra])


def chunked_set(chunks: DataFrame) -> DataFrame:
    """``string_id, string_begin, string_end, file, record, name`` of the records of ``sources.read_fasta_chunks``, in the order of files and records.

    Records with a chunk hold a k-mer, so they are the strings; their letters stay in the chunks.
    """
    records = chunks.groupBy("file", "record").agg(F.min("name").alias("name"), F.min("length").alias("_len"))
    files = records.groupBy("file").agg(F.max("record").alias("_most")).withColumn("_first", F.coalesce(F.sum("_most").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = not_broadcast(records).join(files.select(F.col("file").alias("_f"), "_first"), F.col("file") == F.col("_f")).withColumn("_ord", F.col("_first") + F.col("record")).withColumn("_part", F.lit(0))
    return _placed(rows, ["file", "record", "name"])


def _placed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``string_id, string_begin, string_end`` and the kept columns, of rows ordered by ``_ord`` and ``_part`` with lengths ``_len``."""
    rows = rows.withColumn("_slice", F.floor(F.col("_ord") / SLICE).cast("bigint"))
    totals = _before(rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum("_len").alias("_bases")))
    inside = Window.partitionBy("_slice").orderBy("_ord", "_part")
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_run", F.sum("_len").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = not_broadcast(numbered).join(totals, F.col("_slice") == F.col("_s"))
    end = F.col("_b0") + F.col("_run")
    return joined.select((F.col("_n0") + F.col("_i")).cast("bigint").alias("string_id"), (end - F.col("_len")).cast("bigint").alias("string_begin"), end.cast("bigint").alias("string_end"), *keep)


def _before(totals: DataFrame) -> DataFrame:
    """``_s, _n0, _b0``: of each slice the rows and bases of all slices before it.

    Slices are summed by groups of 2**24, so neither a group nor the groups' totals are more rows than
    that in one task, even if ids are hashes and each has a slice of its own.
    """
    rows = totals.withColumn("_group", F.shiftright("_slice", 24))
    sums = rows.groupBy("_group").agg(F.sum("_n").alias("_gn"), F.sum("_bases").alias("_gb"))
    ahead = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_group").alias("_g"), F.coalesce(F.sum("_gn").over(ahead), F.lit(0)).alias("_n1"), F.coalesce(F.sum("_gb").over(ahead), F.lit(0)).alias("_b1"))
    inside = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("_group", F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_ni"), F.coalesce(F.sum("_bases").over(inside), F.lit(0)).alias("_bi"))
    return not_broadcast(rows).join(sums, F.col("_group") == F.col("_g")).select("_s", (F.col("_n1") + F.col("_ni")).alias("_n0"), (F.col("_b1") + F.col("_bi")).alias("_b0"))


def locate(positions: DataFrame, strings: DataFrame, position: str = "pos", width: int = 512) -> DataFrame:
    """``positions`` with ``string_id, string_begin, string_end`` of the string that covers each; null if none.

    A range join on bins: a string is listed under every bin of ``width`` positions that it
    covers, so the join has an equality and no side is compared with all of the other.
    """
    bins = strings.select(
        F.col("string_id"), F.col("string_begin"), F.col("string_end"),
        F.explode(F.sequence(F.floor(F.col("string_begin") / width), F.floor((F.col("string_end") - 1) / width))).alias("_bin"),
    )
    p = F.col(position)
    cond = (F.floor(p / width) == F.col("_bin")) & (p >= F.col("string_begin")) & (p < F.col("string_end"))
    return positions.join(not_broadcast(bins), cond, "left").drop("_bin")


def kmer_at(positions: DataFrame, strings: DataFrame, k: int, position: str = "pos") -> DataFrame:
    """``positions`` with ``string_id`` and the k-mer that starts there; null where it would leave its string.

    One range join finds the string and its letters: the chunks of the strings lie at most in two bins of a
    chunk's length each, and the places of one long string are dealt over its chunks.
    """
    texts = chunks(strings.select("string_id", "string_begin", "seq"), k, ["string_id", "string_begin"], short=True)
    texts = texts.select("string_id", (F.col("string_begin") + F.col("_c") * CHUNK).alias("_from"), F.least(F.lit(CHUNK), F.length("_text")).alias("_n"), "_text")
    texts = texts.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / CHUNK), F.floor((F.col("_from") + F.col("_n") - 1) / CHUNK))))
    p = F.col(position)
    cond = (F.floor(p / CHUNK) == F.col("_bin")) & (p >= F.col("_from")) & (p < F.col("_from") + F.col("_n"))
    kmer = F.substring("_text", (p - F.col("_from") + 1).cast("int"), F.lit(k))
    return positions.join(not_broadcast(texts), cond, "left").select(*positions.columns, "string_id", F.when(F.length(kmer) == k, kmer).alias("kmer"))


def kmer_in_string(wanted: DataFrame, strings: DataFrame, k: int) -> DataFrame:
    """``string_id, pos`` with the k-mer at that place of that string; null where there is none."""
    return _with_kmer(wanted, F.col("pos"), strings, k)


def kmers_in_ranges(ranges: DataFrame, strings: DataFrame, k: int) -> DataFrame:
    """``string_id, pos`` of every place of ranges (``string_id, first, last``, both included) and the k-mer there; null where there is none.

    A range is cut where the chunks of the strings are, so that a row of the join stands for the places of
    a chunk; places are made behind the join.
    """
    texts = chunks(strings.select("string_id", "seq"), k, ["string_id"]).select(F.col("string_id").alias("_sid"), F.col("_c").cast("bigint").alias("_t"), "_text")
    cut = F.sequence(F.floor(F.col("first") / CHUNK), F.floor(F.col("last") / CHUNK))
    parts = ranges.filter("first <= last").select("string_id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), F.explode(cut).alias("_c"))
    joined = parts.join(not_broadcast(texts), (F.col("string_id") == F.col("_sid")) & (F.col("_c") == F.col("_t")), "left")
    places = F.sequence(F.greatest(F.col("first"), F.col("_c") * CHUNK), F.least(F.col("last"), F.col("_c") * CHUNK + CHUNK - 1))
    kmer = F.substring("_text", (F.pmod(F.col("pos"), F.lit(CHUNK)) + 1).cast("int"), F.lit(k))
    return joined.select("string_id", "_text", F.explode(places).alias("pos")).select("string_id", "pos", F.when(F.length(kmer) == k, kmer).alias("kmer"))


def _with_kmer(rows: DataFrame, place: Column, strings: DataFrame, k: int) -> DataFrame:
    """``rows`` (with ``string_id``) and the k-mer at that place of that string; null where there is none.

    Strings are joined chunk by chunk: a k-mer is cut from a short text, and the places of one
    long string are dealt over its chunks.
    """
    texts = chunks(strings.select("string_id", "seq"), k, ["string_id"]).select(F.col("string_id").alias("_sid"), F.col("_c").cast("bigint").alias("_c"), "_text")
    joined = rows.join(not_broadcast(texts), (F.col("string_id") == F.col("_sid")) & (F.floor(place / CHUNK) == F.col("_c")), "left")
    kmer = F.substring("_text", (F.pmod(place, F.lit(CHUNK)) + 1).cast("int"), F.lit(k))
    return joined.select(*rows.columns, F.when(F.length(kmer) == k, kmer).alias("kmer"))
