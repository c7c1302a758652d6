"""FASTA records of any length, as chunks: a record need not fit a row, a task or a Java string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import is_dna
from strandloom.staging import not_broadcast

#: Letters of a chunk that are its own.
SIZE = 1 << 16


def read_fasta_chunks(spark: SparkSession, path: str, k: int, size: int = SIZE) -> DataFrame:
    """``file, record`` (from 1 in its file), ``name, chunk, length`` (of the record) and ``seq``: the letters of every record of FASTA files, in chunks.

    Chunk c holds the letters from ``c * size`` on, ``size`` of its own and k - 1 more, so each window of k letters is in
    one chunk; a record of fewer than k letters has none.  Files are split over tasks as lines; headers and letters are
    counted split by split, one total a split meets the others in a running sum, and lines are then dealt to their chunks.  A
    line has to fit a row.  Letters other than ACGT, and letters before a file's first header, are errors.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("_text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    lines = lines.filter("_text <> ''").withColumn("_head", F.col("_text").startswith(">").cast("long")).withColumn("_len", F.when(F.col("_head") == 1, 0).otherwise(F.length("_text")).cast("long"))
    own = Window.partitionBy("file", "_block").orderBy("_row")
    lines = lines.withColumn("_heads", F.sum("_head").over(own)).withColumn("_at", F.sum("_len").over(own) - F.col("_len"))
    lines = lines.withColumn("_last", F.max(F.when(F.col("_head") == 1, F.col("_at"))).over(own))  # where the record began, in the split
    splits = lines.groupBy("file", "_block").agg(F.sum("_head").alias("_h"), F.sum("_len").alias("_n"), F.max("_last").alias("_l"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_h0", F.coalesce(F.sum("_h").over(before), F.lit(0))).withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    splits = splits.withColumn("_l0", F.max(F.col("_n0") + F.col("_l")).over(before)).select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_h0", "_n0", "_l0")
    placed = not_broadcast(lines).join(splits, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    start = F.col("_n0") + F.col("_at") - F.when(F.col("_heads") > 0, F.col("_n0") + F.col("_last")).otherwise(F.coalesce("_l0", F.lit(0)))
    placed = placed.select("file", (F.col("_h0") + F.col("_heads")).alias("record"), start.alias("_start"), "_len", "_text", "_head")
    heads = placed.filter("_head = 1").select(F.col("file").alias("_hf"), F.col("record").alias("_hr"), F.trim(F.expr("substring(_text, 2)")).alias("name"))
    letters = placed.filter("_head = 0")
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why} in "), "file", F.lit(": "), F.substring("_text", 1, 60))).cast("string")
    good = F.when(F.col("record") < 1, wrong("letters before the first header")).when(is_dna(F.col("_text")), F.upper("_text")).otherwise(wrong("a sequence holds letters other than ACGT"))
    first, last = F.floor(F.greatest(F.col("_start") - (k - 1), F.lit(0)) / size), F.floor((F.col("_start") + F.col("_len") - 1) / size)
    pieces = letters.select("file", "record", "_start", "_len", good.alias("_text")).withColumn("chunk", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("_start"), F.col("chunk") * size), F.least(F.col("_start") + F.col("_len"), (F.col("chunk") + 1) * size + k - 1)
    cut = F.substr("_text", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = pieces.filter(lo < hi).select("file", "record", "chunk", F.struct(lo.alias("at"), cut.alias("text")).alias("_piece"), (F.col("_start") + F.col("_len")).alias("_end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["text"]), "")
    found = pieces.groupBy("file", "record", "chunk").agg(text.alias("seq"), F.max("_end").alias("_end"))
    sizes = letters.groupBy(F.col("file").alias("_sf"), F.col("record").alias("_sr")).agg(F.max(F.col("_start") + F.col("_len")).alias("length"))
    found = found.filter(F.length("seq") >= k).join(not_broadcast(heads), (F.col("file") == F.col("_hf")) & (F.col("record") == F.col("_hr")))
    found = found.join(not_broadcast(sizes), (F.col("file") == F.col("_sf")) & (F.col("record") == F.col("_sr")))
    return found.select("file", "record", "name", "chunk", "length", "seq")
