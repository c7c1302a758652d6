"""Readers and writers of sequence files."""

from strandloom.sources.chunked import read_fasta_chunks
from strandloom.sources.sequences import is_sequence_file, map_records, read_any, read_fasta, read_fastq, read_kmer_list, read_plain, read_queries, read_segments, segment_errors, sequence_counts, write_fasta, write_plain

__all__ = ["is_sequence_file", "map_records", "read_any", "read_fasta", "read_fasta_chunks", "read_fastq", "read_kmer_list", "read_plain", "read_queries", "read_segments", "segment_errors", "sequence_counts", "write_fasta", "write_plain"]
