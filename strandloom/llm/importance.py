"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import scan, smallest_hashed, stage
from strandloom.llm.wordhash import Hasher, U, chunks, mix


def features(hasher: Hasher, texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of every word and every pair of neighbouring words."""
    w = hasher.words(texts)
    near = w.doc[1:] == w.doc[:-1]
    pair = mix(w.hash[:-1] * U(3) + w.hash[1:])[near]
    return np.concatenate((w.doc, w.doc[:-1][near])), (np.concatenate((w.hash, pair)) % U(buckets)).astype(np.int64)


def count_ngrams(docs: DataFrame, target_ids: frozenset, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all texts and over the target texts, from one scan.

    Every task sends at most one row per bucket; they are summed by bucket, so the driver
    receives ``buckets`` rows whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, held in chunks(texts):
                doc, bucket = features(hasher, held, buckets)
                counts[0] += np.bincount(bucket, minlength=buckets)
                target = np.array([i in target_ids for i in ids[at : at + len(held)]], bool)
                counts[1] += np.bincount(bucket[target[doc]], minlength=buckets)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "target"])

    rows = scan(docs, run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    out = np.zeros((2, buckets))
    for r in rows:
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out[0], out[1]


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The exact k-th largest value of a double column, by narrowing a histogram of 4096 cells; null if there is none."""
    low, high = float("-inf"), float("inf")
    rest, left = df.filter(F.col(col).isNotNull()), k
    while True:
        part = rest.filter((F.col(col) >= F.lit(low)) & (F.col(col) <= F.lit(high))) if low > float("-inf") else rest
        span = part.agg(F.min(col), F.max(col), F.count(col)).first()
        if not span[2] or left > span[2]:
            return None
        low, high = span[0], span[1]
        if low == high or left == span[2]:
            return low
        if span[2] <= 10_000:
            return sorted((r[0] for r in part.select(col).collect()), reverse=True)[left - 1]
        width = (high - low) / 4096
        cell = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(4095)).cast("int")
        cells = part.groupBy(cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.min(col).alias("_lo"), F.max(col).alias("_hi")).collect()
        for r in sorted(cells, key=lambda r: -r["_c"]):
            if left <= r["_n"]:
                low, high = r["_lo"], r["_hi"]
                break
            left -= r["_n"]
        if low == high:
            return low


def resample_by_importance(
    docs: DataFrame, labels: DataFrame, keep: float | None = None, buckets: int = 16384, target_sample: int = 20000, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Sample texts without replacement, in proportion to how much likelier good text makes them than raw text.

    Words and word pairs are hashed into ``buckets``.  The raw model counts them over all
    texts; the target model over at most ``target_sample`` texts labelled ``quality = 1``
    (those with the smallest hashed ids).  A text's log weight is the sum over its n-grams of
    log p(target) - log p(raw) (add-one smoothed), so its weight is the likelihood ratio of the
    two models; the sample is the k texts with the greatest log weight plus Gumbel noise, which
    is drawn from a hash of the id and ``seed``: successive draws without replacement, each in
    proportion to the weights left.  ``k`` is ``keep`` of all rows; by default the share of good
    texts among the labels.

    Returns ``id_col, n_grams, log_weight, sample_key`` of the sampled rows.  A null, empty or
    blank text has no n-grams and the log weight 0, that of a text of which both models think
    alike.  Rows tied with the k-th key, such as repeats of one row, are all taken; an empty
    table gives no rows; other columns are ignored.
    """
    known = labels.filter(F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y"))
    share = known.agg(F.avg((F.col("_y") == 1).cast("double"))).first()[0]
    keep = (share if share is not None else 1.0) if keep is None else keep
    good = smallest_hashed(known.filter("_y = 1").select("_id"), target_sample)
    target_ids = frozenset(r["_id"] for r in good.collect())
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    raw, target = count_ngrams(source, target_ids, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, held in chunks(batch.column(1).to_pylist()):
                doc, bucket = features(hasher, held, buckets)
                n[at : at + len(held)] = np.bincount(doc, minlength=len(held))
                total[at : at + len(held)] = np.bincount(doc, ratio[bucket], minlength=len(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total)], names=["_id", "n_grams", "_total"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = scan(source, run, f"_id {id_type}, n_grams long, _total double")
    even = (F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.round("_total", 9)
    rows = rows.select("_id", "n_grams", weight.alias("log_weight"), (weight - F.log(-F.log(even))).alias("sample_key"))
    rows = stage(rows, "importance")
    k = int(np.ceil(keep * rows.count()))
    least = kth_largest(rows, "sample_key", k) if k else None
    found = rows.filter(F.col("sample_key") >= F.lit(least)) if least is not None else rows.limit(0)
    return found.withColumnRenamed("_id", id_col)
