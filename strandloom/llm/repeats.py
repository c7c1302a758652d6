"""Substring dedup: hashes of lines and of content-defined parts of lines, first occurrence kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import columns_of, fresh, join_counted, scan, stage
from strandloom.llm.wordhash import Hasher, U, chunks, mix


def unit_starts(hash_: np.ndarray, line: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words that begin a unit: every line's first, and the least hash of every
    ``width`` words of a line.  The choice depends on nothing outside those words, so equal
    passages fall into equal units wherever they stand, but for ``width`` words at either end."""
    n = len(hash_)
    begins = np.zeros(n, bool)
    if not n:
        return np.flatnonzero(begins)
    begins[0] = True
    begins[1:] = line[1:] != line[:-1]
    if n >= width:
        inside = line[width - 1 :] == line[: n - width + 1]
        least = np.lib.stride_tricks.sliding_window_view(hash_, width).argmin(axis=1)
        begins[(np.arange(n - width + 1) + least)[inside]] = True
    return np.flatnonzero(begins)


def units_of(hasher: Hasher, texts: list[bytes], width: int) -> dict[str, np.ndarray]:
    """All units of a chunk of texts: text index, number, digest, words, and code point offsets."""
    w = hasher.words(texts)
    ends = np.flatnonzero(w.buf == 10)
    line = np.searchsorted(ends, w.start)
    start = unit_starts(w.hash, line, width)
    stop = np.append(start[1:], len(w.hash)) if len(start) else start
    digest = hasher.spans(w.hash, start, stop)
    # Code points: bytes that do not continue a character, counted from the text's first byte.
    chars = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((w.buf & 0xC0) != 0x80, out=chars[1:])
    doc = w.doc[start]
    base = chars[w.first_byte[doc]] if len(doc) else doc
    first_of = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
    number = np.arange(len(doc)) - np.repeat(first_of, np.diff(np.append(first_of, len(doc))))
    return {"doc": doc, "unit": number, "digest": digest.view(np.int64), "words": stop - start, "start": chars[w.start[start]] - base, "end": chars[w.end[stop - 1]] - base}


def run_starts(unit: np.ndarray, digest: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every unit of one text (in order) from which neighbouring units cover ``least`` words:
    its index, and a digest of the fewest such units."""
    total = np.append(0, np.cumsum(words))
    stop = np.searchsorted(total, total[:-1] + least)  # total[stop] is the first that reaches it
    fits = np.flatnonzero(stop < len(total))
    fits = fits[unit[stop[fits] - 1] - unit[fits] == stop[fits] - 1 - fits]
    stop, out = stop[fits], np.zeros(len(fits), U)
    for k in range(int((stop - fits).max()) if len(fits) else 0):
        live = fits + k < stop
        out[live] = mix(out[live] + U(1)) ^ digest[fits[live] + k].view(U)
    return fits, mix(out).view(np.int64)


def add_run_digests(units: DataFrame, least: int) -> DataFrame:
    """``_id, unit, far``: the digest of the units from ``unit`` on that cover ``least`` words, without a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            one = pa.Table.from_batches(held).combine_chunks()
            at, far = run_starts(*(one.column(k).to_numpy() for k in (1, 2, 3)), least)
            return one.select([0, 1]).take(pa.array(at)).append_column("far", pa.array(far)).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            for a, b in zip(edges, edges[1:]):
                if held and b > a and held[-1].column(0)[0].as_py() != ids[a]:
                    yield from emit(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held)

    id_type = units.schema["_id"].dataType.simpleString()
    ordered = units.select("_id", "unit", "digest", "words").repartition("_id").sortWithinPartitions("_id", "unit")
    return scan(ordered, run, f"_id {id_type}, unit int, far long")


def find_repeats(docs: DataFrame, min_words: int = 20, width: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of text that stand elsewhere too and are not the earliest occurrence.

    Units are lines, and parts of lines between words chosen by content, so that a passage
    which begins inside a line is met too.  They are compared as lower-cased words; digests
    are grouped over all texts, the occurrence with the least (id, unit number) is kept, and
    neighbouring units of which an earlier one exists are joined.  A stretch goes if one text
    keeps at least ``min_words`` words of it, or if neighbouring units of it that cover
    ``min_words`` words stand together earlier, whichever texts hold these units first.  So a
    passage is met if it is whole in an earlier text and its whole units hold ``min_words``
    words together.

    Returns ``id_col, start, end, n_words, kept_id``: code points of the original text, end
    exclusive; ``kept_id`` is the text that keeps most of the stretch, or, if none keeps enough,
    the first that holds such neighbours.  Null, empty and blank texts have no units.
    Rows that share an id are one text that is repeated: it is no repeat of itself.  An empty
    table gives no rows; other columns are ignored.
    """

    id_field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, held in chunks(batch.column(1).to_pylist()):
                u = units_of(hasher, held, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(u["doc"] + at)), pa.array(u["digest"]), pa.array(u["unit"].astype(np.int32)), pa.array(u["words"].astype(np.int32)), pa.array(u["start"].astype(np.int32)), pa.array(u["end"].astype(np.int32))],
                    names=["_id", "digest", "unit", "words", "start", "end"],
                )

    schema = f"_id {id_field.dataType.simpleString()}, digest long, unit int, words int, start int, end int"
    units = scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema)
    # Digests met once are most of all; only those met twice go on, as a table of their own.
    first = F.min(F.struct("_id", "unit"))
    twice = units.groupBy(F.col("digest").alias("_digest")).agg(first.alias("_first"), F.max(F.struct("_id", "unit")).alias("_last"), F.count(F.lit(1)).alias("_n"))
    twice = stage(twice.filter("_first <> _last").select("_digest", "_first", "_n"), "repeat-digests")
    again = join_counted(units, twice, "digest", "_digest", "_n", ["_id", "unit"]).groupBy("_id", "unit")
    again = stage(again.agg(F.min("digest").alias("digest"), F.max("words").alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("_first").alias("_first")), "repeat-units")
    # Neighbours that stand together twice, though each was first met elsewhere.
    far = stage(add_run_digests(again, min_words), "repeat-runs")
    far_first = far.groupBy(F.col("far").alias("_far")).agg(first.alias("_far_first"), F.max(F.struct("_id", "unit")).alias("_far_last"), F.count(F.lit(1)).alias("_n"))
    far_first = stage(far_first.filter("_far_first <> _far_last").select("_far", "_far_first", "_n"), "repeat-far")
    met = join_counted(far, far_first, "far", "_far", "_n", ["_id", "unit"]).filter(~(F.struct("_id", "unit").eqNullSafe(F.col("_far_first"))))
    met = met.select(F.col("_id").alias("_met_id"), F.col("unit").alias("_met_unit"), F.struct(F.col("_far_first._id").alias("id")).alias("_met"))
    later = again.filter(~(F.struct("_id", "unit").eqNullSafe(F.col("_first")))).withColumn("_kept", F.col("_first._id"))
    later = later.join(met, F.col("_id").eqNullSafe(F.col("_met_id")) & (F.col("unit") == F.col("_met_unit")), "left").select("_id", "unit", "words", "start", "end", "_kept", "_met")
    of_text = Window.partitionBy("_id").orderBy("unit")
    runs = later.withColumn("_run", F.col("unit") - F.row_number().over(of_text))
    # Two short lines that come from different texts are no passage, though they stand together.
    per_text = runs.groupBy("_id", "_run", "_kept").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("_met").alias("_met"))
    found = per_text.groupBy("_id", "_run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").cast("long").alias("n_words"), F.max("words").alias("_most"), F.max_by("_kept", "words").alias("_keeps"), F.min("_met").alias("_met")
    )
    enough = F.col("_most") >= min_words
    kept = F.when(enough, F.col("_keeps")).otherwise(F.col("_met.id"))
    return found.filter(enough | F.col("_met").isNotNull()).select(F.col("_id").alias(id_col), "start", "end", "n_words", kept.alias("kept_id"))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans, which are code points of it and do not overlap."""
    if not text:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, min_words: int = 20, width: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all but the earliest occurrence of repeated stretches cut out (``find_repeats``).

    The removed spans of the original text stand in a last column ``removed``, empty if none; if
    ``docs`` has a column of that name, it stays and the new one has underscores before its name.
    Null and empty texts stay as they are, repeated rows are cut alike, an empty table gives no rows.
    """
    removed = fresh(docs.columns, "removed")
    spans = find_repeats(docs, min_words, width, id_col, text_col)
    spans = spans.groupBy(F.col(id_col).alias("_cut_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    rows = docs.select(F.struct(*columns_of(docs)).alias("_row"), F.col(id_col).alias("_own_id"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = rows.join(spans, F.col("_own_id").eqNullSafe(F.col("_cut_id")), "left").select("_row.*", F.coalesce("_cut", none).alias(removed))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([cut(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(cols[at].to_pylist(), cols[-1].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return scan(joined, run, joined.schema)
