"""k-mers as strings, and as integers of which the first base stands in the lowest bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.bases import BASES, DIGITS, reverse_complement

#: Most bases of one signed 64-bit integer.
LONG_BASES = 31


def order_key(col: Column) -> Column:
    """A string that sorts among k-mers of one length as their integers do."""
    return F.reverse(F.translate(col, BASES, DIGITS))


def pack(col: Column) -> Column:
    """The integer of a k-mer of at most 31 bases (two bits a base: never negative)."""
    return F.conv(order_key(col), 4, 10).cast("bigint")


def unpack(bits: Column, k: int) -> Column:
    return F.translate(F.reverse(F.lpad(F.conv(bits.cast("string"), 10, 4), k, "0")), DIGITS, BASES)


def canonical(col: Column) -> Column:
    """The lesser, as integers, of a k-mer and its reverse complement."""
    other = reverse_complement(col)
    return F.when(order_key(col) < order_key(other), col).otherwise(other)


def key_of_order(order: Column, k: int) -> Column:
    """What equal k-mers are joined on, from their order key: one long up to 31 bases, three
    beyond (63 bases do not fit two)."""
    if k <= LONG_BASES:
        return F.conv(order, 4, 10).cast("bigint")
    limbs = []
    for i, a in enumerate(range(0, k, LONG_BASES)):
        n = min(LONG_BASES, k - a)
        limbs.append(F.conv(F.substring(order, k - a - n + 1, n), 4, 10).cast("bigint").alias(f"l{i}"))
    return F.struct(*limbs)


def kmer_of_key(key: Column, k: int) -> Column:
    """The k-mer of a join key."""
    if k <= LONG_BASES:
        return unpack(key, k)
    return F.concat(*[unpack(key[f"l{i}"], min(LONG_BASES, k - a)) for i, a in enumerate(range(0, k, LONG_BASES))])


def join_key(col: Column, k: int) -> Column:
    return key_of_order(order_key(col), k)


def reverse_order_key(col: Column) -> Column:
    """The order key of the reverse complement: both reversals cancel."""
    return F.translate(col, "ACGT", "2310")


def get_base(col: Column, pos: int) -> Column:
    return F.substring(col, pos + 1, 1)


def set_base(col: Column, pos: int, base: Column) -> Column:
    return F.overlay(col, base, F.lit(pos + 1), F.lit(1))


def append_base(col: Column, base: Column, k: int) -> Column:
    """The k-mer with a base put before its first and its last one dropped."""
    return F.concat(base, F.substring(col, 1, k - 1))


def is_query_kmer(col: Column, k: int) -> Column:
    return F.coalesce((F.length(col) == k) & col.rlike("^[ACGTacgt]*$"), F.lit(False))


def mix31(value: Column, seed: int = 1) -> Column:
    """A 31-bit hash of a packed minimizer, in plain integer arithmetic; one seed serves build and query."""
    start = F.pmod(value.bitwiseXOR(F.lit(1431655765 * seed % (1 << 62)).cast("bigint")), F.lit(2147483647))
    return start * F.lit(48271).cast("bigint") % F.lit(2147483647)


def ceil_log2(col: Column) -> Column:
    """Least e with 2**e >= n, by counting bits, so exact; 0 up to 1."""
    return F.when(col <= 1, F.lit(0)).otherwise(F.length(F.bin(col.cast("bigint") - 1))).cast("int")
