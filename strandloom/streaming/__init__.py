"""Scans of reads that arrive as a stream."""

from strandloom.streaming.reads import chunk_scan, read_stream, run_once, stream_scan

__all__ = ["chunk_scan", "read_stream", "run_once", "stream_scan"]
