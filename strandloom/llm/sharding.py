"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, number_rows, stage

DIMS = ("size", "tokens", "one")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, by the dot product of its vector with the residual capacities.

    ``items`` holds a row per item and a column per dimension.  Dimensions are scaled so
    that a shard's fair share is one.  Items go largest first; each goes, among the shards
    where it fits, to the one whose residual capacity has the greatest dot product with it,
    and where it fits nowhere, to the one it overfills least.  ``level`` then evens out what
    the last items left uneven.
    """
    total = items.sum(axis=0).astype(float)
    scaled = items / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, items.shape[1]))
    out = np.empty(len(items), dtype=np.int32)
    for i in np.lexsort((np.arange(len(items)), -scaled.max(axis=1))):
        v = scaled[i]
        fits = (left >= v - 1e-12).all(axis=1)
        score = np.where(fits, left @ v, -np.inf) if fits.any() else (left - v).min(axis=1)
        out[i] = k = int(np.argmax(score))
        left[k] -= v
    return level(scaled, out, shards, 10 * shards)


def level(items: np.ndarray, shard: np.ndarray, shards: int, rounds: int) -> np.ndarray:
    """Lower the sum of squared loads by moving an item, or swapping two, between two shards a round.

    The pairs tried are the fullest and the emptiest shard in each dimension; if they are at
    their best, the one furthest from its fair share and every other.  Ends when no exchange helps.
    """
    shard = shard.copy()
    load = np.zeros((shards, items.shape[1]))
    np.add.at(load, shard, items)
    none = np.zeros((1, items.shape[1]))

    def best(a: int, b: int) -> tuple[float, int, int, int, int]:
        """The greatest gain of an exchange of an item (or none, -1) of ``a`` for one of ``b``."""
        own, other = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        x, y, gap = np.concatenate([none, items[own]]), np.concatenate([none, items[other]]), load[a] - load[b]
        # The moved vector v = x - y gains v . (gap - v).
        gain = (x @ gap - (x * x).sum(axis=1))[:, None] - (y @ gap + (y * y).sum(axis=1))[None, :] + 2 * (x @ y.T)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        return float(gain[i, j]), a, b, int(own[i - 1]) if i else -1, int(other[j - 1]) if j else -1

    for _ in range(rounds):
        pairs = {(int(load[:, d].argmax()), int(load[:, d].argmin())) for d in range(items.shape[1])}
        found = max(best(a, b) for a, b in sorted(pairs))
        if found[0] <= 1e-9:
            far = int(np.abs(load - load.mean(axis=0)).max(axis=1).argmax())
            found = max((best(far, b) for b in range(shards) if b != far), default=found)
        gain, a, b, i, j = found
        if gain <= 1e-9:
            break
        for item, source, target in ((i, a, b), (j, b, a)):
            if item >= 0:
                shard[item] = target
                load[source] -= items[item]
                load[target] += items[item]
    return shard


def shard_by_vector_packing(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bundles: int = 8192, big_share: float = 0.005
) -> DataFrame:
    """Assign every row to a shard so that bytes, tokens and rows are near equal in all shards.

    Rows of equal text form a group that stays together, unless it is larger than one
    shard's fair share in some dimension: then it is split into pieces far below that share.
    Groups above ``big_share`` of a fair share are packed one by one (at most
    ``3 * shards / big_share`` exist); all others fall by hash into ``bundles`` bundles,
    which are packed as units.  So the driver sees a bounded number of vectors at any scale.

    Returns ``id_col, size, text_crc32, tokens, shard, slot``.  A null text counts as
    empty: size 16, crc 0, no tokens; all null and empty texts are one group.  Repeated
    rows are placed each; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("_group"),
    )
    rows = stage(rows, "shard-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("one")]
    total = rows.agg(*sums).first()
    fair = {d: max(float(total[d] or 0) / shards, 1.0) for d in DIMS}
    groups = stage(rows.groupBy("_group").agg(*sums), "shard-groups")

    share = F.greatest(*[F.col(d) / F.lit(fair[d]) for d in DIMS])
    big = stage(
        groups.filter(share > big_share).select(
            F.col("_group").alias("_big"), F.when(share > 1, F.ceil(share / F.lit(big_share * 4))).otherwise(1).cast("int").alias("_pieces")
        ),
        "shard-big",
    )
    item = rows.join(F.broadcast(big), F.col("_group") == F.col("_big"), "left").withColumn(
        "_piece",
        F.when(F.col("_big").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_pieces")).cast("int")),
    )
    item = item.withColumn("_unit", F.when(F.col("_big").isNull(), F.pmod(F.xxhash64("_group"), F.lit(bundles))).otherwise(F.col("_group"))).drop("_big", "_pieces", "_group")
    units = item.groupBy("_unit", "_piece").agg(*sums).orderBy("_unit", "_piece").collect()
    vectors = np.array([[u[d] for d in DIMS] for u in units], dtype=float).reshape(len(units), len(DIMS))
    chosen = place(vectors, shards)
    table = docs.sparkSession.createDataFrame([(u["_unit"], u["_piece"], int(s)) for u, s in zip(units, chosen)], "_u long, _p int, shard int")
    placed = item.join(F.broadcast(table), (F.col("_unit") == F.col("_u")) & (F.col("_piece") == F.col("_p"))).drop("_u", "_p", "_unit", "_piece")
    placed = number_rows(placed, ["shard"], [F.col("_id"), F.col("text_crc32"), F.col("size")], "slot", total["one"])
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "tokens", "shard", "slot")
