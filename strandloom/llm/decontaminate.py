"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers bit-parallel distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.common import columns_of, fresh, scan, stage
from strandloom.llm.wordhash import Hasher, U, chunks

#: ASCII characters that are no letters and no digits part words; all others stand for themselves.
APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Most bytes of benchmark text that are broadcast; a larger benchmark is joined by the hashes of its pieces.
BROADCAST_BYTES = 1 << 20
#: Most bits of the bitmap that keeps the hashes of texts which are no piece's from the shuffle.
BITMAP_BITS = 1 << 27


def normalise(text: str) -> list[bytes]:
    """Lower-cased words of a text, without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(APART).split()


def budget(n_words: int, rate: float) -> int:
    return int(n_words * rate + 1e-9)


def pieces(words: list[bytes], errors: int) -> list[tuple[int, list[bytes]]]:
    """``errors + 1`` consecutive pieces of near equal length, each with its offset in words.

    At most ``errors`` words differ, so in any match at least one piece stands unchanged.
    """
    n, k = len(words), errors + 1
    cut = [i * n // k for i in range(k + 1)]
    return [(a, words[a:b]) for a, b in zip(cut, cut[1:])]


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a stretch of ``text`` and the (first) end of that stretch."""
    m = len(pattern)
    eq: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        eq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text, 1):
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best


def best_match(own: list[bytes], errors: int, words: list[bytes], starts: Iterable[int]) -> tuple[int, int, int] | None:
    """(distance, first word, end word) of the best match of an item near any of the starts, if it is within the errors."""
    best = None
    lo = hi = -1
    for s in [*sorted(starts), None]:
        if s is not None and s - errors <= hi:  # one stretch for all starts whose windows meet
            hi = max(hi, s + len(own) + errors)
            continue
        if hi > 0:
            d, e = myers(own, words[max(lo, 0) : hi])
            if d <= errors and (best is None or d < best[0]):
                best = d, max(lo, 0) + e
        if s is not None:
            lo, hi = s - errors, s + len(own) + errors
    if best is None:
        return None
    d, e = best
    # The start: the same search backwards from the end.
    _, back = myers(own[::-1], words[max(0, e - len(own) - errors) : e][::-1])
    return d, e - back, e


class Searcher:
    """All items of a small benchmark: an automaton over their pieces, and the words to verify against."""

    def __init__(self, items: list[tuple[object, str]], rate: float, min_words: int):
        import ahocorasick

        self.ids, self.words, self.errors = [], [], []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = normalise(text)
            if len(words) < min_words:
                continue
            k = budget(len(words), rate)
            for offset, piece in pieces(words, k):
                where[" " + b" ".join(piece).decode("latin-1") + " "].append((len(self.ids), offset))
            self.ids.append(item)
            self.words.append(words)
            self.errors.append(k)
        self.automaton = ahocorasick.Automaton()
        for key, found in where.items():
            self.automaton.add_word(key, (len(key), found))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, first word, end word) of every item in the text, its best match."""
        if not self.ids or not text:
            return []
        words = normalise(text)
        line = " " + b" ".join(words).decode("latin-1") + " "
        spans: dict[int, set[int]] = defaultdict(set)
        at = None
        for end, (size, found) in self.automaton.iter(line):
            if at is None:
                at = np.cumsum([1 + len(w) for w in words]) - [len(w) for w in words]
            first = int(np.searchsorted(at, end - size + 2))
            for item, offset in found:
                spans[item].add(first - offset)
        found = ((item, best_match(self.words[item], self.errors[item], words, starts)) for item, starts in spans.items())
        return [(self.ids[item], *hit) for item, hit in found if hit]


def small_items(items: DataFrame, id_col: str, text_col: str) -> list[tuple[object, str]] | None:
    """The items, if their number and their bytes, counted first, allow a broadcast; else null."""
    held = items.select(F.col(id_col).alias("_item"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = held.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    return sorted(((r["_item"], r["_text"]) for r in held.collect()), key=repr)


def piece_hashes(items: DataFrame, rate: float, min_words: int) -> DataFrame:
    """``_hash, _no, _at, _size`` (words) of every piece of the items ``_no, _text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = []
            for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normalise(text or "")
                if len(words) >= min_words:
                    cuts = pieces(words, budget(len(words), rate))
                    start = np.array([at for at, _ in cuts])
                    size = np.array([len(piece) for _, piece in cuts])
                    found = hasher.spans(hasher.words([b" ".join(words)]).hash, start, start + size).view(np.int64)
                    rows += zip(found.tolist(), [no] * len(cuts), start.tolist(), size.tolist())
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["_hash", "_no", "_at", "_size"])

    return scan(items.select("_no", "_text"), run, "_hash long, _no long, _at int, _size int")


def search_by_hash(rows: DataFrame, items: DataFrame, rate: float, min_words: int) -> DataFrame:
    """``_row, _no, distance, first_word, end_word`` of every match of ``rows`` (``_row, _text``) and ``items`` (``_no, _text``).

    Pieces of items and stretches of texts of the same numbers of words meet by their hashes in
    a join; a bitmap of the pieces' hashes, of fixed greatest size, keeps most stretches from
    being sent.  Candidates then meet their text and item and are verified.  The texts are
    scanned once, whatever the number of items.
    """
    pieces_ = stage(piece_hashes(items, rate, min_words), "pieces")
    sizes = sorted(r[0] for r in pieces_.select("_size").distinct().collect())
    bits = 1 << 16
    while bits < min(16 * pieces_.count(), BITMAP_BITS):
        bits *= 2
    slot = pieces_.select(F.pmod("_hash", F.lit(bits)).alias("_b"))
    words = slot.groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_b & 63 as int)))").alias("_v")).toPandas()
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[words["_w"].to_numpy(np.int64)] = words["_v"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.view(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in chunks(batch.column(1).to_pylist()):
                held = [b" ".join(normalise(t.decode("utf-8", "surrogatepass"))) for t in texts]
                w = hasher.words(held)
                first = np.searchsorted(w.doc, np.arange(len(held)))
                for size in sizes:
                    i = np.arange(max(len(w.hash) - size + 1, 0))
                    i = i[w.doc[i] == w.doc[i + size - 1]]
                    h = hasher.spans(w.hash, i, i + size)
                    slot = h % U(bits)
                    hit = (table[slot >> U(6)] >> (slot & U(63)) & U(1)).astype(bool)
                    i, h = i[hit], h[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + w.doc[i]]), pa.array(h.view(np.int64)), pa.array((i - first[w.doc[i]]).astype(np.int32)), pa.array(np.full(len(i), size, np.int32))], names=["_row", "_h", "_pos", "_s"])

    hits = scan(rows.select("_row", "_text"), run, "_row long, _h long, _pos int, _s int")
    met = hits.join(pieces_, (F.col("_h") == F.col("_hash")) & (F.col("_s") == F.col("_size")))
    met = met.groupBy("_row", "_no").agg(F.collect_set(F.col("_pos") - F.col("_at")).alias("_starts"))
    met = met.join(items.select(F.col("_no").alias("_i"), F.col("_text").alias("_item_text")), F.col("_no") == F.col("_i")).drop("_i")
    met = met.join(rows.select(F.col("_row").alias("_r"), "_text"), F.col("_row") == F.col("_r")).select("_row", "_no", "_starts", "_item_text", "_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            out = []
            for row, no, starts, item, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row != last:
                    last, words = row, normalise(text or "")
                own = normalise(item)
                if hit := best_match(own, budget(len(own), rate), words, starts):
                    out.append((row, no, *hit))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_row", "_no", "distance", "first_word", "end_word"])

    return scan(met, verify, "_row long, _no long, distance long, first_word long, end_word long")


def numbered(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return stage(items.select(F.monotonically_increasing_id().alias("_no"), F.col(item_col).alias("_item"), F.col(text_col).alias("_text")), "items")


def find_contamination(
    docs: DataFrame, items: DataFrame, rate: float = 0.2, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per text and benchmark item that it holds with at most ``rate`` of the item's words changed.

    Texts and items are compared as lower-cased words without ASCII punctuation.  Each item
    is split into its error budget plus one pieces, exact piece hits are found, by an automaton
    for items of at most ``BROADCAST_BYTES`` in total and else by a join of hashes, and Myers'
    bit-parallel algorithm over words verifies the stretch around each hit.

    Returns ``id_col, item_col, distance, first_word, end_word`` (the best match, in words of
    the compared form, end exclusive).  Null and empty texts hold nothing.  Items of fewer
    than ``min_words`` words match nothing.  Repeated rows are reported each; an empty table
    on either side gives no rows; other columns are ignored.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    small = small_items(items, item_col, item_text_col)
    if small is None:
        rows, held = stage(source.withColumn("_row", F.monotonically_increasing_id()), "numbered"), numbered(items, item_col, item_text_col)
        found = search_by_hash(rows, held, rate, min_words)
        found = found.join(held.select(F.col("_no").alias("_i"), "_item"), F.col("_no") == F.col("_i")).join(rows.select(F.col("_row").alias("_r"), "_id"), F.col("_row") == F.col("_r"))
        return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "distance", "first_word", "end_word")
    ids, item_ids = to_arrow_type(docs.schema[id_col].dataType), to_arrow_type(items.schema[item_col].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, rate, min_words)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in searcher.search(t or "")]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (ids, item_ids, *[pa.int64()] * 3))], names=["_id", "_item", "distance", "first_word", "end_word"])

    return scan(source, run, f"_id {id_type}, _item {item_type}, distance long, first_word long, end_word long").withColumnsRenamed({"_id": id_col, "_item": item_col})


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.2, min_words: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged; see ``find_contamination``.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives no rows,
    an empty benchmark drops none, and columns of any name pass through.
    """
    small = small_items(items, item_col, item_text_col)
    if small is None:
        row = fresh(docs.columns, "_row")
        held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        bad = search_by_hash(held.select(F.col(row).alias("_row"), F.col(text_col).alias("_text")), numbered(items, item_col, item_text_col), rate, min_words)
        bad = stage(bad.select(F.col("_row").alias("_contaminated")).distinct(), "contaminated").withColumnRenamed("_contaminated", fresh([*docs.columns, row], "_contaminated"))
        return held.join(bad, held[row] == F.col(bad.columns[0]), "left_anti").select(*columns_of(docs))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, rate, min_words)
        for batch in batches:
            yield batch.filter(pa.array([not searcher.search(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

    return scan(docs, run, docs.schema)
