"""Length-bucketed packing: optimal bucket boundaries, then token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, number_rows, stage


def best_boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``counts`` maps a length to its number of sequences.  ``best[j]`` is the least
    padding of the first ``j`` lengths; one more bucket is added per round.
    """
    if not counts:
        return []
    length = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(x)] for x in length], dtype=np.int64)
    many = np.concatenate(([0], np.cumsum(n)))
    mass = np.concatenate(([0], np.cumsum(n * length)))
    size = len(length)
    best = np.full(size + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, size)):
        new, frm = best.copy(), np.full(size + 1, -1)
        for j in range(1, size + 1):
            cost = best[:j] + length[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], frm[j] = cost[i], i
        back.append(frm)
        best = new
    cuts, j = [], size
    for frm in reversed(back):
        if j and frm[j] >= 0:
            cuts.append(int(length[j - 1]))
            j = int(frm[j])
    return sorted(cuts)


def pack_by_length(
    docs: DataFrame, buckets: int = 16, max_tokens: int = 4096, budget: int = 65536, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every text into sequences of at most ``max_tokens`` words and batch them with little padding.

    A text longer than ``max_tokens`` gives consecutive sequences (``seq_no`` from 0,
    ``first_token`` its offset in words), so no token is lost and the global length
    histogram has at most ``max_tokens`` entries: that bounds the dynamic programme.
    Inside a bucket, batches hold ``max(1, budget // bucket_len)`` sequences each
    (the last may hold fewer), dealt in a hashed order.

    Returns ``id_col, seq_no, first_token, n_tokens, bucket, bucket_len, batch, place``:
    ``batch`` is gapless from 0 in its bucket, ``place`` in its batch.  A null, empty or
    blank text has one sequence of 0 tokens, in the first bucket.  Repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_words"))
    step = F.lit(max_tokens).cast("long")
    cut = rows.select("_id", "_words", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("_words") - 1, F.lit(0)) / step).cast("long"))).alias("seq_no"))
    cut = cut.select("_id", "seq_no", (F.col("seq_no") * step).alias("first_token"), F.least(F.col("_words") - F.col("seq_no") * step, step).alias("n_tokens"))
    cut = stage(cut, "pack-rows")
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = best_boundaries(histogram, buckets)
    table = docs.sparkSession.createDataFrame(
        [(k, b, c) for k in histogram for b, c in [next((b, c) for b, c in enumerate(cuts) if c >= k)]], "_k long, bucket int, bucket_len long"
    )
    rows = cut.join(F.broadcast(table), F.col("n_tokens") == F.col("_k")).drop("_k")
    order = [F.xxhash64("_id", "seq_no"), F.col("_id"), F.col("seq_no"), F.col("n_tokens")]
    rows = number_rows(rows, ["bucket"], order, "_at", sum(histogram.values()))
    held = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))).cast("long"))
    return rows.select(
        F.col("_id").alias(id_col), "seq_no", "first_token", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("_at") / held).cast("long").alias("batch"), (F.col("_at") % held).cast("long").alias("place"),
    )
