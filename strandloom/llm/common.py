"""Helpers shared by the operators: text scans, staged tables, distributed row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Most bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or in local mode a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_strandloom_shared", None)
    if made is None:
        made = spark.sparkContext._strandloom_shared = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return made


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and gives the
    planner exact sizes, so small tables are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes as well as by rows.

    With a ``StructType``, that of a table with a user's columns, ``fn`` meets the columns by place,
    as ``c0, c1, ...``, and gives them so: names with dots or quotes do not resolve.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # plans read it when they run
    if isinstance(schema, str):
        return df.mapInArrow(fn, schema)
    placed = StructType([StructField(f"c{k}", f.dataType, f.nullable, f.metadata) for k, f in enumerate(schema)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(fn, placed).toDF(*schema.names)


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as make it clash with no name, whatever the case."""
    held = {n.lower() for n in names}
    while wanted.lower() in held:
        wanted = f"_{wanted}"
    return wanted


def join_counted(left: DataFrame, right: DataFrame, left_key: str, right_key: str, count: str, spread: list[str], hot_rows: int = 10_000) -> DataFrame:
    """Inner join on a key that is unique on the right, where ``count`` is the number of its rows on the left.

    Keys of more than ``hot_rows`` rows, and of more than a ten-thousandth of all, are broadcast:
    at most 10,000 rows of the right.  Their rows on the left are dealt out by the columns ``spread``,
    so no task gathers one key, whatever its share.  The columns of the right but for ``count`` follow
    those of the left.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    names = [c for c in right.columns if c != count]
    hot = stage(right.filter(F.col(count) > max(hot_rows, total // 10_000)).select(F.col(right_key).alias("_hot_key"), F.struct(*names).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return left.join(right.drop(count), F.col(left_key) == F.col(right_key))
    cold = right.filter(F.col(count) <= max(hot_rows, total // 10_000)).select(F.col(right_key).alias("_cold_key"), F.struct(*names).alias("_cold"))
    dealt = left.join(F.broadcast(hot), F.col(left_key) == F.col("_hot_key"), "left").withColumn("_dealt", F.when(F.col("_hot").isNull(), F.col(left_key)).otherwise(F.xxhash64(*spread).cast(left.schema[left_key].dataType)))
    both = dealt.join(cold, (F.col("_dealt") == F.col("_cold_key")) & F.col("_hot").isNull(), "left").withColumn("_met", F.coalesce("_hot", "_cold"))
    return both.filter(F.col("_met").isNotNull()).select(*left.columns, *[F.col(f"_met.{c}").alias(c) for c in names])


def number_rows(df: DataFrame, group: list[str], order: list[Column], out: str, rows: int) -> DataFrame:
    """Gapless numbers from 0 within each group, for groups of any size.

    Every group is dealt over slices by the hash of the ordering columns, one for each million
    of the ``rows`` of all groups and 64 at least; a slice is numbered alone and shifted by the
    total of the slices before it.  Only a group's slice totals meet in one task.
    """
    parts = max(64, rows // 1_000_000)
    df = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    keyed = [c for c in [*group, "_slice"]]
    own = Window.partitionBy(*keyed).orderBy(*order)
    numbered = df.withColumn("_own", F.row_number().over(own) - 1)
    cond = None
    shift = shift.select(*[F.col(c).alias(f"_s_{c}") for c in keyed], "_shift")
    for c in keyed:
        one = F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        cond = one if cond is None else cond & one
    joined = numbered.join(shift, cond)
    return joined.withColumn(out, (F.col("_own") + F.col("_shift")).cast("long")).drop("_own", "_shift", "_slice", *[f"_s_{c}" for c in keyed])


def smallest_hashed(df: DataFrame, n: int, id_col: str = "_id") -> DataFrame:
    """The ``n`` rows of the smallest hashed ids, ties by id and the other columns.

    Of a large table, only about ``2 * n`` rows under a hash bound go on to the exact choice:
    a plain ordered limit would send up to ``n`` rows from every task.
    """
    total, h = df.count(), F.xxhash64(id_col)
    if total > 4 * n:
        under = df.filter(h < F.lit(-(1 << 63) + (1 << 64) * 2 * n // total))
        df = under if under.count() >= n else df
    return df.orderBy(h, *df.columns).limit(n)
