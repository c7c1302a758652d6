"""Bases: two-bit codes A=0, C=1, T=2, G=3, so that a complement flips the high bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, DIGITS = "ACTG", "0123"


def encode_bases(col: Column) -> Column:
    """Digits of the codes of a string of bases, either case; null if another letter occurs."""
    return F.when(is_dna(col), F.translate(F.upper(col), BASES, DIGITS))


def decode_bases(col: Column) -> Column:
    """Bases of a string of code digits."""
    return F.translate(col, DIGITS, BASES)


def complement(col: Column) -> Column:
    return F.translate(col, "ACGT", "TGCA")


def reverse_complement(col: Column) -> Column:
    return F.reverse(complement(col))


def is_dna(col: Column) -> Column:
    """Whether a string holds nothing but ACGT in either case; an empty one does."""
    return col.rlike("^[ACGTacgt]*$")


def pack_bytes(col: Column) -> Column:
    """Binary of four bases a byte, the first in the low bits; the last byte is filled with zero bits."""
    digits = F.translate(F.upper(col), BASES, DIGITS)
    filled = F.rpad(digits, (F.ceil(F.length(col) / 4) * 4).cast("int"), F.lit("0"))
    # In a reversed group of four digits the first base is lowest: two hex digits each.
    groups = F.transform(F.regexp_extract_all(filled, F.lit("(?s).{4}"), F.lit(0)), lambda g: F.lpad(F.conv(F.reverse(g), 4, 16), 2, "0"))
    return F.unhex(F.array_join(groups, ""))


def unpack_bytes(data: Column, length: Column) -> Column:
    """The first ``length`` bases of packed bytes; fewer if the bytes end before."""
    groups = F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda h: F.reverse(F.lpad(F.conv(h, 16, 4), 4, "0")))
    return F.substring(decode_bases(F.array_join(groups, "")), F.lit(1), length.cast("int"))
