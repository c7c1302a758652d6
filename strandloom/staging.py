"""Tables written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``; in local mode a temporary one)."""
    home = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def not_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not send it whole to the driver and every executor.

    What is exploded, hashed into letters or grouped by k-mer is estimated from the few bytes of the table it
    comes from, so the planner would take an index of any size for a small table; both sides are sorted and merged instead.
    """
    return df.hint("merge")


@contextmanager
def held_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots as two underscores) for some writes, and then as they were."""
    names = {name.replace("__", "."): value for name, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: What a finished write has shuffled goes at once, and not when the driver happens to collect its garbage.
DROP_SHUFFLES = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: cuts the lineage, survives lost executors and tells the planner its size.

    Such tables stay as long as the shared folder, so they are compressed well: letters of four take little more than two bits.
    """
    path = scratch(df.sparkSession, name)
    with held_conf(df.sparkSession, **DROP_SHUFFLES):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
