"""Table functions for SQL text: the k-mers and the super-k-mers of a sequence, as rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

CODE = {"A": 0, "C": 1, "T": 2, "G": 3}


def is_plain(seq: str) -> bool:
    return not seq.strip("ACGT")


class Kmers:
    """``pos, kmer`` of every window of k letters; no rows for a null or a shorter sequence."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        if k < 1:
            raise ValueError(f"k must be positive, not {k}")
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


class SuperKmers:
    """``first_pos, minimizer, pos_in_kmer, num_kmers`` of the runs of windows that share a minimizer at one place.

    The m-mer of the least hash wins, the leftmost of ties, as in ``windows.super_kmers``; m-mers are packed
    and hashed one base at a time and the least of a window is kept in a queue, so the time is linear.
    """

    def eval(self, seq: str, k: int, m: int, seed: int) -> Iterator[tuple[int, int, int, int]]:
        seq = (seq or "").upper()
        if not 1 <= m < k:
            raise ValueError(f"m must be between 1 and k - 1, not {m}")
        if not is_plain(seq):
            raise ValueError(f"a sequence holds letters other than ACGT: {seq[:60]}")
        salt, value, queue, run = 1431655765 * seed % (1 << 62), 0, deque(), None
        for end, base in enumerate(seq):
            value = value >> 2 | CODE[base] << 2 * (m - 1)
            at = end - m + 1
            if at < 0:
                continue
            mixed = (value ^ salt) % 2147483647 * 48271 % 2147483647
            while queue and queue[-1][0] > mixed:
                queue.pop()
            queue.append((mixed, at, value))
            window = end - k + 1
            if window < 0:
                continue
            while queue[0][1] < window:
                queue.popleft()
            _, place, least = queue[0]
            if run is not None and run[1:3] == (least, place):
                run = (*run[:3], run[3] + 1)
                continue
            if run is not None:
                yield run[0], run[1], run[2] - run[0], run[3]
            run = window, least, place, 1
        if run is not None:
            yield run[0], run[1], run[2] - run[0], run[3]


def register_table_functions(spark: SparkSession) -> None:
    """``kmers(seq, k)`` and ``super_kmers(seq, k, m, seed)`` for ``FROM t, LATERAL ...`` in this session, fed by Arrow batches."""
    spark.udtf.register("kmers", udtf(Kmers, returnType="pos int, kmer string", useArrow=True))
    spark.udtf.register("super_kmers", udtf(SuperKmers, returnType="first_pos int, minimizer bigint, pos_in_kmer int, num_kmers int", useArrow=True))
