"""Near-duplicates: SimHash fingerprints in segment-popcount cells, MinHash bands for texts beyond their radius; exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import columns_of, join_counted, scan, stage
from strandloom.llm.components import connected_components
from strandloom.llm.wordhash import STEP, U, mix

LOW = 0x5555555555555555
#: Least hashes that make one band.
BAND = 6
#: Runs up to this length compare all neighbours at once; longer ones grow spanning trees.
SHORT_RUN = 8


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` consecutive words (all words of a shorter text; none of a blank one).

    Words are lower-cased A-Z, joined by a space and hashed by XXH64 with seed 42.
    """
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, U)
    line = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(own))
    starts, ends = (end - size)[: len(own) - k + 1].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), U, len(starts))


def fingerprint(text: str, words: int, lanes: int) -> np.ndarray:
    """``lanes`` unsigned 64-bit words; bit i is set if it is in over half of the hashes of ``shingles``.

    Further lanes mix those hashes anew.
    """
    return majority(shingles(text, words), lanes)


def majority(h: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of hashes."""
    if not len(h):
        return np.zeros(lanes, U)
    out = np.empty(lanes, U)
    for lane in range(lanes):
        x = h if lane == 0 else mix(h + U(lane * STEP % (1 << 64)))
        count = np.zeros(64, np.int64)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        out[lane] = np.packbits(2 * count > len(h), bitorder="little").view(U)[0]
    return out


def lanes_of(n: int) -> list[str]:
    return [f"f{k}" for k in range(n)]


def add_fingerprints(docs: DataFrame, words: int, lanes: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _h`` (hash of the text) and the lanes of the fingerprint as signed longs, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "", words, lanes) for t in batch.column(2).to_pylist()], U).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(found[:, k])) for k in range(lanes)]], names=["_id", "_h", *lanes_of(lanes)])

    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    return scan(source, run, f"_id {id_type}, _h long, " + ", ".join(f"{c} long" for c in lanes_of(lanes)))


def segment_counts(x: np.ndarray) -> np.ndarray:
    """Bits set in every two-bit segment, packed in place."""
    return x - ((x >> U(1)) & U(LOW))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed segment counts; never more than the bits in which the fingerprints differ."""
    x = a ^ b
    return np.bitwise_count(x & U(LOW)).astype(np.int64) + 2 * np.bitwise_count((x >> U(1)) & ~x & U(LOW)).astype(np.int64)


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows (lanes in columns) differ in at most ``radius`` bits: the bound first, then exactly."""
    bound = sum(manhattan(segment_counts(x[:, k]), segment_counts(y[:, k])) for k in range(x.shape[1]))
    ok = np.flatnonzero(bound <= radius)
    out = np.zeros(len(x), bool)
    out[ok] = sum(np.bitwise_count(x[ok, k] ^ y[ok, k]).astype(np.int64) for k in range(x.shape[1])) <= radius
    return out


def run_links(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links inside every run of equal cells; a spanning forest of each long run.

    A long run is searched from point to point: a point's neighbours leave the pool at once,
    so a dense group costs little more than its length and never yields all its pairs.
    """
    n = len(cell)
    if n < 2:
        return
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(starts, n))
    length = np.repeat(size, size)
    for d in range(1, SHORT_RUN):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & (length[:-d] <= SHORT_RUN))
        i = i[near(fp[i], fp[i + d], radius)] if len(i) else i
        if len(i):
            yield node[i], node[i + d]
    for s, k in zip(starts[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist()):
        pool = np.arange(s, s + k)
        while len(pool):
            todo, pool = [int(pool[-1])], pool[:-1]
            while todo and len(pool):
                p = todo.pop()
                hit = near(np.broadcast_to(fp[p], (len(pool), fp.shape[1])), fp[pool], radius)
                if hit.any():
                    found = pool[hit]
                    yield np.full(len(found), node[p]), node[found]
                    todo += found.tolist()
                    pool = pool[~hit]


def link_cells(cells: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Links ``a, b`` (nodes) between fingerprints that share a cell and differ in at most ``radius`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            cell, fp, node = (np.concatenate(x) for x in zip(*parts))
            for a, b in run_links(cell, fp, node, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp = np.stack([batch.column(2 + k).to_numpy() for k in range(lanes)], axis=1).view(U)
            last = int(np.searchsorted(cell, cell[-1]))  # the final run may go on in the next batch
            if held and (last or held[-1][0][-1] != cell[-1]):
                yield from emit([*held, (cell[:last], fp[:last], node[:last])])
                held = []
            elif last:
                yield from emit([(cell[:last], fp[:last], node[:last])])
            held.append((cell[last:], fp[last:], node[last:]))
        if held:
            yield from emit(held)

    sorted_cells = cells.select("cell", "node", *lanes_of(lanes)).repartition("cell").sortWithinPartitions("cell")
    return scan(sorted_cells, run, "a long, b long")


def groups_for(points: int, radius: int) -> int:
    """The number of segment groups for which cells and comparisons of so many points cost least.

    ``m`` groups give a point one cell for every choice of ``m - radius``; the counts of two-bit
    segments hold 1.5 bits each, so so many points of chance share a cell.  Any choice finds all links.
    """
    return min(range(2 * radius, min(4 * radius, 32) + 1), key=lambda m: math.comb(m, radius) * (8 + points / 2 ** (48 * (m - radius) / m)))


def exact_cells(points: DataFrame, radius: int, groups: int) -> DataFrame:
    """All cells of one-lane fingerprints such that any two within ``radius`` bits share one.

    The two-bit segments' counts are cut into ``groups`` groups.  Counts differ in total
    (Manhattan) by at most ``radius``, so in at least ``groups - radius`` groups they agree: the
    grid cells are the counts of every choice of so many groups.
    """
    edges = [2 * (32 * g // groups) for g in range(groups + 1)]
    masks = [sum(((1 << b) - 1) & ~((1 << a) - 1) for a, b in (edges[g : g + 2] for g in chosen)) for chosen in combinations(range(groups), groups - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # Halves of 32 bits keep the subtraction inside the signed range.
    upper = F.shiftrightunsigned("f0", 32) - F.shiftrightunsigned(F.shiftrightunsigned("f0", 32), 1).bitwiseAND(F.lit(LOW >> 32))
    lower_half = F.col("f0").bitwiseAND(F.lit(0xFFFFFFFF))
    lower = lower_half - F.shiftrightunsigned(lower_half, 1).bitwiseAND(F.lit(LOW >> 32))
    counts = F.shiftleft(upper, 32).bitwiseOR(lower)
    coded = points.withColumn("_v", counts)
    cells = F.array(*[F.xxhash64(F.col("_v").bitwiseAND(F.lit(m)), F.lit(k)) for k, m in enumerate(signed)])
    return coded.select("node", "f0", F.explode(cells).alias("cell"))


def group_fingerprints(rows: DataFrame, lanes: int, radius: int) -> DataFrame:
    """``node, root`` of every distinct fingerprint that links with another one; every link is found.

    Copies are one fingerprint, so they cost nothing here.
    """
    if lanes != 1:
        raise ValueError("exact cells are made for fingerprints of 64 bits")
    points = stage(rows.select(F.col("_node").alias("node"), *lanes_of(lanes)).distinct(), "fingerprints")
    return connected_components(link_cells(exact_cells(points, radius, groups_for(points.count(), radius)), lanes, radius))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row, with all links of at most ``radius`` differing bits.

    Returns ``id_col, fingerprint`` (16 lower-case hex digits) and ``component_id``, the
    smallest id reachable.  A null, empty or blank text has the fingerprint zero, which links
    like any other.  A null id never names a component unless all its ids are null.  Repeated
    rows are given each; an empty table gives no rows; other columns are ignored.
    """
    rows = stage(add_fingerprints(docs, words, 1, id_col, text_col).withColumn("_node", F.col("f0")), "simhash")
    roots = group_fingerprints(rows, 1, radius)
    least = rows.groupBy("_node").agg(F.min("_id").alias("_least"))
    joined = least.join(roots, F.col("_node") == F.col("node"), "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root"))
    joined = stage(joined, "rooted")
    per_root = stage(joined.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_many")), "roots")
    named = join_counted(joined, per_root, "_root", "_r", "_many", ["_node"])
    # A copied text is a key of many rows: its fingerprint is looked up as such.
    copies = rows.groupBy(F.col("_node").alias("_c")).agg(F.count(F.lit(1)).alias("_copies"))
    named = stage(named.join(copies, F.col("_node") == F.col("_c")).select(F.col("_node").alias("_n"), "component_id", "_copies"), "components")
    out = join_counted(rows, named, "_node", "_n", "_copies", ["_id"])
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def bands_for(similarity: float, miss: float) -> int:
    """Bands of which sets of this Jaccard similarity share none with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**BAND)))) if similarity < 1 else 1


def band_cells(h: np.ndarray, bands: int) -> np.ndarray:
    """A cell for every band: its number and the least of all hashes under ``BAND`` orders of its own."""
    keys = mix(np.arange(1, 2 * bands * BAND + 1, dtype=U) * U(STEP)).reshape(2, -1, 1)
    turn, times = keys[0], keys[1] | U(1)
    least = np.full(bands * BAND, np.iinfo(U).max, U)
    for at in range(0, len(h), 256):
        least = np.minimum(least, ((h[at : at + 256] ^ turn) * times).min(axis=1))
    cell = np.arange(bands, dtype=U) * U(STEP)
    for column in least.reshape(bands, BAND).T:
        cell = mix(cell ^ column) + U(1)
    return cell


def add_bands(docs: DataFrame, words: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _h`` (hash of the text), ``_bytes`` (its length), ``f0`` (its fingerprint) and ``cells``, those of its bands, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t or "", words) for t in batch.column(2).to_pylist()]
            prints = pa.array(np.array([majority(h, 1)[0] for h in hashes], U).view(np.int64))
            cells = [band_cells(h, bands) for h in hashes]
            flat = pa.array(np.concatenate([np.zeros(0, U), *cells]).view(np.int64))
            edges = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), prints, pa.ListArray.from_arrays(edges, flat)], names=["_id", "_h", "_bytes", "f0", "cells"])

    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("_bytes"))
    return scan(source, run, f"_id {id_type}, _h long, _bytes long, f0 long, cells array<long>")


def star_links(cells: DataFrame) -> DataFrame:
    """Links ``a, b`` of every node to the least one in each of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # cell and least node of the final run, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            least = node[starts]
            if held is not None and held[0] == cell[0]:
                least[0] = held[1]
            held = int(cell[-1]), int(least[-1])
            least = np.repeat(least, np.diff(np.append(starts, len(cell))))
            other = least != node
            yield pa.RecordBatch.from_arrays([pa.array(least[other]), pa.array(node[other])], names=["a", "b"])

    return scan(cells.select("cell", "node").repartition("cell").sortWithinPartitions("cell", "node"), run, "a long, b long")


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For every set of distinct hashes the index of one set of its group; sets link if their exact
    Jaccard similarity is at least ``similarity``.

    The search goes from set to set, as in ``run_links``; overlaps are counted along the members of
    the pool or along the sets that hold the hashes, whichever are fewer.
    """
    ratio = Fraction(str(similarity))
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    edge = np.append(0, np.cumsum(size))
    _, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    by_code = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[by_code]
    at = np.append(0, np.cumsum(np.bincount(code))) if len(code) else np.zeros(1, np.int64)
    root = np.arange(len(sets))
    free = np.ones(len(sets), bool)
    mark = np.zeros(len(at), bool)
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        todo = [first]
        while todo:
            p = todo.pop()
            own, n = code[edge[p] : edge[p + 1]], int(size[p])
            lo = np.searchsorted(size, -(-n * ratio.numerator // ratio.denominator))
            hi = np.searchsorted(size, n * ratio.denominator // ratio.numerator, "right")
            pool = lo + np.flatnonzero(free[lo:hi])
            if not len(pool):
                continue
            if not n:
                found = pool
            else:
                if (at[own + 1] - at[own]).sum() < size[pool].sum():
                    held = np.concatenate([holder[at[c] : at[c + 1]] for c in own])
                    both = np.bincount(held, minlength=len(sets))[pool]
                else:
                    mark[own] = True
                    if 2 * len(pool) > hi - lo:
                        total = np.append(0, np.cumsum(mark[code[edge[lo] : edge[hi]]]))
                        both = total[edge[pool + 1] - edge[lo]] - total[edge[pool] - edge[lo]]
                    else:
                        both = np.array([np.count_nonzero(mark[code[edge[q] : edge[q + 1]]]) for q in pool])
                    mark[own] = False
                found = pool[both * ratio.denominator >= (n + size[pool] - both) * ratio.numerator]
            free[found] = False
            root[found] = first
            todo += found.tolist()
    out = np.empty(len(sets), np.int64)
    out[order] = order[root]
    return out


def keep_verified(rows: DataFrame, words: int, similarity: float, text_at: int) -> DataFrame:
    """Of ``rows`` (columns of the documents, then ``_group, _first``) those of the least ``_first`` of the
    classes that links of at least ``similarity`` make inside each ``_group``, by the texts' own shingles."""
    n = len(rows.columns) - 2
    schema = rows.select(*rows.columns[:n]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = pa.Table.from_batches(held).combine_chunks()
            root = similar_groups([np.unique(shingles(t or "", words)) for t in one.column(text_at).to_pylist()], similarity)
            first = [(x["id"] is None, x["id"], x["h"]) for x in one.column(n + 1).to_pylist()]
            least: dict[int, int] = {}
            for i, r in enumerate(root.tolist()):
                if r not in least or first[i] < first[least[r]]:
                    least[r] = i
            yield from one.select(range(n)).take(pa.array(sorted(least.values()))).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(n).to_pylist()
            edges = [0, *[i for i in range(1, len(group)) if group[i] != group[i - 1]], len(group)]
            for a, b in zip(edges, edges[1:]):
                if held and b > a and held[-1].column(n)[0].as_py() != group[a]:
                    yield from emit(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held)

    return scan(rows.repartition("_group").sortWithinPartitions("_group"), run, schema)


def distances(texts: DataFrame, centers: DataFrame, words: int) -> DataFrame:
    """``_group, node, both, either``: shingles common with, and in either of, the text and its group's center.

    A center's text is dealt to a slice of its group for every shuffle partition, so a group of any size is spread.
    """
    slices = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = texts.select("_group", F.pmod(F.xxhash64("node"), F.lit(slices)).cast("int").alias("_slice"), F.lit(1).alias("_kind"), "node", "_text")
    heads = centers.select("_group", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), F.lit(0).alias("_kind"), "node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, U)
        for batch in batches:
            out = []
            for group, kind, node, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                own = np.unique(shingles(text or "", words))
                if not kind:
                    head = own
                else:
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    out.append((group, node, both, len(head) + len(own) - both))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_group", "node", "both", "either"])

    return scan(heads.unionByName(sliced).repartition("_group", "_slice").sortWithinPartitions("_group", "_slice", "_kind"), run, "_group long, node long, both long, either long")


#: Rounds of one center a group before what is left of a large group is taken cell by cell.
CENTER_ROUNDS = 8


def center_links(texts: DataFrame, words: int, similarity: float, most: int, rounds: int | None) -> tuple[DataFrame | None, DataFrame]:
    """Links ``a, b`` that settle texts of groups of more than ``most`` bytes in so many rounds, and the texts that are left.

    ``texts`` has ``_group, node, _text, _open``.  In every round one open text of each such group is
    its center, and all others of the group are compared with it, in parallel.  One less by
    Jaccard, similarity is a metric: a text at distance x of the center can only link with texts
    nearer than x + 1 - ``similarity``.  So a text that is linked with the center, and nearer than
    the nearest unlinked one less that, has no other links that matter, and leaves the group.  No
    link is lost, the center always leaves, and no group is ever gathered while it is large.
    """
    ratio, links, rest = Fraction(str(similarity)), None, []
    while rounds is None or rounds > 0:
        sizes = texts.groupBy("_group").agg(F.sum(F.octet_length("_text") + 64).alias("_b"), F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_open"), F.col("node"))).alias("_center"))
        large = stage(sizes.filter((F.col("_b") > most) & F.col("_center").isNotNull()).select(F.col("_group").alias("_g"), "_center", "_n"), "large-groups")
        if large.isEmpty():
            break
        own = stage(join_counted(texts, large, "_group", "_g", "_n", ["node"]).drop("_g"), "large-texts")
        rest.append(texts.join(large, F.col("_group") == F.col("_g"), "left_anti"))
        centers = own.filter("node = _center")
        far = stage(distances(own.filter("node <> _center"), centers, words), "distances")
        linked = F.col("both") * ratio.denominator >= F.col("either") * ratio.numerator
        away = 1 - F.col("both") / F.greatest(F.col("either"), F.lit(1))
        near = far.join(large.select("_g", "_center"), F.col("_group") == F.col("_g")).filter(linked).select(F.col("_center").alias("a"), F.col("node").alias("b"))
        near = stage(near, "center-links")
        links = near if links is None else links.unionByName(near)
        least = far.filter(~linked).groupBy(F.col("_group").alias("_lg")).agg(F.min(away).alias("_least"))
        left = far.join(least, F.col("_group") == F.col("_lg")).filter(~linked | (away >= F.col("_least") - (1 - similarity) - 1e-9)).select(F.col("_group").alias("_left_group"), F.col("node").alias("_left"), linked.alias("_linked"))
        texts = own.join(left, (F.col("node") == F.col("_left")) & (F.col("_group") == F.col("_left_group")))
        texts = stage(texts.select("_group", "node", "_text", (F.col("_open") & ~F.col("_linked")).alias("_open")), "open-texts")
        rounds = None if rounds is None else rounds - 1
    return links, texts if not rest else _union([*rest, texts])


def link_large_groups(texts: DataFrame, words: int, similarity: float, most: int, cells: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Links ``a, b`` that settle groups of more than ``most`` bytes, and what is left to compare in one task a group.

    ``texts`` has ``_group, node, _text, _open``, and ``cells`` the band cells of each ``node``.  A group of
    near copies empties in a few rounds of ``center_links``.  A group that chance or a chain of gradual changes
    holds together would take a round for almost every text, so after ``CENTER_ROUNDS`` what is left of
    it falls into its cells: texts that link share one, and a cell holds no more than alike texts.
    """
    links, left = center_links(texts, words, similarity, most, CENTER_ROUNDS)
    sizes = left.groupBy("_group").agg(F.sum(F.octet_length("_text") + 64).alias("_b"), F.count(F.lit(1)).alias("_n"))
    large = stage(sizes.filter(F.col("_b") > most).select(F.col("_group").alias("_g"), "_n"), "lasting-groups")
    if large.isEmpty():
        return links, left
    left = stage(left, "left-texts")
    own = join_counted(left, large, "_group", "_g", "_n", ["node"]).drop("_g")
    dealt = own.join(cells.select(F.col("node").alias("_cell_node"), "cell"), F.col("node") == F.col("_cell_node")).select(F.xxhash64("_group", "cell").alias("_group"), "node", "_text", F.lit(True).alias("_open"))
    several = dealt.groupBy(F.col("_group").alias("_g")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    dealt = stage(join_counted(stage(dealt, "cell-texts"), stage(several, "cell-sizes"), "_group", "_g", "_n", ["node"]).drop("_g"), "cell-groups")
    more, rest = center_links(dealt, words, similarity, most, None)
    found = [x for x in (links, more) if x is not None]
    return _union(found) if found else None, _union([left.join(large, F.col("_group") == F.col("_g"), "left_anti"), rest])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``a, b`` of every text to one of its class, for groups that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            node = np.fromiter(held, np.int64, len(held))
            return pa.RecordBatch.from_arrays([pa.array(node[similar_groups(list(held.values()), similarity)]), pa.array(node)], names=["a", "b"])

        group, held = None, {}
        for batch in batches:
            for g, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and g != group:
                    yield emit(held)
                    held = {}
                group = g
                held[node] = np.unique(shingles(text or "", words))
        if held:
            yield emit(held)

    # A text of several groups is there once a group, and a group of one text links it with itself.
    return scan(texts.select("_group", "node", "_text").repartition("_group").sortWithinPartitions("_group"), run, "a long, b long")


def keep_one_of_each(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, miss: float = 1e-9, large_group: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without near-duplicates: of every group one row, that of the least id, stays unchanged.

    Candidates are first texts whose SimHash fingerprints differ in at most ``radius`` bits, all of them, by
    ``group_fingerprints``.  A pair of this ``similarity`` differs in more bits as a rule, so the groups of
    fingerprints (or single ones) meet further, by the MinHash bands of their texts' sets of ``words``-word shingles: a pair of
    this ``similarity`` shares none with probability ``miss`` at most, however many rows there
    are, and a more similar pair more rarely.  Of these only texts link whose shingle sets have
    a Jaccard similarity of ``similarity`` at least, counted exactly.  Candidate groups of up to
    ``large_group`` bytes of different texts are compared in one task, larger ones by
    ``link_large_groups``, in few rounds whatever their form; both ways give the same rows.

    Equal texts always fall together, null and blank ones too; a null id comes last.  Of rows that
    agree in id and text one stays.  An empty table gives no rows, and columns of any name pass through.
    """
    # Equal texts are one node.
    rows = stage(add_bands(docs, words, bands_for(similarity, miss), id_col, text_col), "bands")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    firsts = rows.groupBy(F.col("_h").alias("_node")).agg(F.min(order).alias("_first"), F.max("_bytes").alias("_bytes"), F.min("f0").alias("f0"))
    repeated = rows.groupBy("_id", "_h").count().filter("count > 1").select("_id", F.col("_h").alias("_rep_h"))
    firsts = firsts.join(repeated, (F.col("_node") == F.col("_rep_h")) & F.col("_first.id").eqNullSafe(F.col("_id")), "left")
    firsts = firsts.select("_node", F.col("_first.id").alias("_held"), "_bytes", F.col("_rep_h").isNotNull().alias("_rep"), "f0")
    # A class is a group of fingerprints that links make, or one of its own; equal fingerprints are few texts each, as texts are distinct here.
    links = stage(group_fingerprints(rows.select(F.col("f0").alias("_node"), "f0"), 1, radius), "fingerprint-groups")
    firsts = stage(firsts.join(links, F.col("f0") == F.col("node"), "left").select("_node", "_held", "_bytes", "_rep", F.coalesce("root", "f0").alias("_class")), "texts")
    alike = rows.select(F.col("_h").alias("_text"), "f0", "cells").dropDuplicates(["_text"])
    cells = alike.select(F.col("_text").alias("node"), F.explode("cells").alias("cell"))
    near = connected_components(star_links(alike.join(links, F.col("f0") == F.col("node"), "left").select(F.coalesce("root", "f0").alias("node"), F.explode("cells").alias("cell"))))
    many = firsts.groupBy("_class").agg(F.count(F.lit(1)).alias("_many"))
    classes = many.join(near, F.col("_class") == F.col("node"), "left").select(F.col("_class").alias("_c"), "_many", F.coalesce("root", F.when(F.col("_many") > 1, F.col("_class"))).alias("_group"))
    held = stage(join_counted(firsts, stage(classes, "classes"), "_class", "_c", "_many", ["_node"]).select("_node", "_held", "_bytes", "_rep", "_group"), "candidates")
    sizes = held.filter("_group is not null").groupBy(F.col("_group").alias("_g")).agg(F.sum(F.col("_bytes") + 64).alias("_b"), F.count(F.lit(1)).alias("_n"))
    large = stage(sizes.filter(F.col("_b") > large_group).select("_g", "_n"), "large")
    source = docs.select(F.struct(*columns_of(docs)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"))
    if not large.isEmpty():
        own = stage(join_counted(held.filter("_group is not null"), large, "_group", "_g", "_n", ["_node"]).drop("_g"), "large-held")
        one = source.join(own, (F.col("_h") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_held")))
        one = one.select("_group", F.col("_node").alias("node"), F.col(f"_row.`{text_col}`").alias("_text"), F.lit(True).alias("_open")).dropDuplicates(["node"])
        links, rest = link_large_groups(stage(one, "large-rows"), words, similarity, large_group, cells)
        links = class_links(rest, words, similarity) if links is None else links.unionByName(class_links(rest, words, similarity))
        roots = connected_components(links).select(F.col("node").alias("_n"), "root")
        order = F.struct(F.col("_held").isNull().alias("none"), F.col("_held").alias("id"), F.col("_node").alias("node"))
        kept = own.join(roots, F.col("_node") == F.col("_n"), "left").groupBy(F.coalesce("root", "_node").alias("_root")).agg(F.min(order).alias("_k"))
        kept = kept.select(F.col("_k.node").alias("_k"))
        settled = own.join(kept, F.col("_node") == F.col("_k"), "left_semi").select("_node", "_held", "_bytes", "_rep", F.lit(None).cast("long").alias("_group"))
        small = held.join(own.select(F.col("_node").alias("_n")), F.col("_node") == F.col("_n"), "left_anti")
        held = stage(small.unionByName(settled), "settled")

    def found(part: DataFrame) -> DataFrame:
        part = part.select("_node", "_held", "_group", "_rep")
        return source.join(part, (F.col("_h") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_held")))

    # Only rows that agree in id and text, few as a rule, are dealt out again to leave one of them.
    one = Window.partitionBy("_id", "_h").orderBy(F.lit(1))

    def single(part: DataFrame) -> DataFrame:
        several = stage(held.filter("_rep"), "repeated")
        plain = found(part.filter("not _rep"))
        if several.isEmpty():
            return plain
        again = found(several).join(part.select(F.col("_node").alias("_p")), F.col("_h") == F.col("_p"), "left_semi")
        return plain.unionByName(again.withColumn("_one", F.row_number().over(one)).filter("_one = 1").drop("_one"))

    alone = single(held.filter("_group is null")).select("_row.*")
    grouped = single(held.filter("_group is not null")).select("_row.*", F.col("_group"), F.struct(F.col("_id").alias("id"), F.col("_h").alias("h")).alias("_first"))
    grouped = grouped.toDF(*[f"c{k}" for k in range(len(docs.columns))], "_group", "_first")
    together = keep_verified(grouped, words, similarity, docs.columns.index(text_col)).toDF(*docs.columns)
    return alone.unionByName(together)
