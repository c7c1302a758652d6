"""Relational operators on sequences, k-mers, minimizers and buckets."""
