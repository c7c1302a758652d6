"""Column functions on bases and k-mers."""

from strandloom.functions.bases import complement, decode_bases, encode_bases, is_dna, pack_bytes, reverse_complement, unpack_bytes
from strandloom.functions.kmers import append_base, canonical, ceil_log2, get_base, is_query_kmer, join_key, key_of_order, kmer_of_key, mix31, order_key, pack, reverse_order_key, set_base, unpack
from strandloom.functions.sql import register_sql_functions
from strandloom.functions.table import register_table_functions

__all__ = [
    "append_base", "canonical", "ceil_log2", "complement", "decode_bases", "encode_bases", "get_base", "is_dna", "is_query_kmer", "join_key", "key_of_order", "kmer_of_key", "mix31",
    "order_key", "pack", "pack_bytes", "register_sql_functions", "register_table_functions", "reverse_complement", "reverse_order_key", "set_base", "unpack", "unpack_bytes",
]
