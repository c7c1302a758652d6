"""Structured Streaming: whole reads need no state; reads in chunks keep their last k - 1 bases and their last hit."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues, ValueState
from pyspark.sql.types import BooleanType, StructField, StructType

from strandloom.operators.lookups import lookup_windows
from strandloom.operators.scan import scan_lookup

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet folder as a stream of reads."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_scan(reads: DataFrame, index: DataFrame, k: int, canonical_mode: bool = False) -> DataFrame:
    """The plan of the batch scan, as a stream-static join: every micro-batch is looked up alone."""
    return scan_lookup(reads, index, k, canonical_mode)


class Pieces(StatefulProcessor):
    """Chunks of reads (``start, seq``) put in order: every chunk with the k - 1 bases before it.

    Reads are grouped by a hash, since a call for each read would cost far more than its state; the
    state of each is its own all the same: how far it has come, its last k - 1 bases, and the chunks that
    wait for one before them.  It ends when the watermark has passed its last chunk by the time held: chunks
    that still wait are given without what is missing before them, and a row of ``start`` -1 tells the
    next operator that the read is over.
    """

    def __init__(self, k: int, hold_ms: int, id_kind: str) -> None:
        self.k, self.hold_ms, self.id_kind = k, hold_ms, id_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.come = handle.getMapState("come", f"query_id {self.id_kind}", "next long, tail string, waiting long, due long")
        self.waiting = handle.getMapState("waiting", f"query_id {self.id_kind}, start long", "seq string")
        self.timer = handle.getValueState("timer", "due long")

    def _out(self, pieces: list[tuple[object, int, str]]) -> pd.DataFrame:
        held = [p for p in pieces if len(p[2]) >= self.k]
        return pd.DataFrame({"_bucket": [0] * len(held), "query_id": pd.Series([p[0] for p in held], dtype=object), "start": [p[1] for p in held], "seq": pd.Series([p[2] for p in held], dtype=object)})

    def _waiting(self) -> dict[object, dict[int, str]]:
        """The waiting chunks of all reads of the bucket: one pass a call, since a pass for each read would cost the square of the reads."""
        found: dict[object, dict[int, str]] = {}
        for (read, start), (seq,) in self.waiting.iterator():
            found.setdefault(read, {})[start] = seq
        return found

    def _follow(self, read: object, at: int, tail: str, chunks: dict[int, str], flush: bool) -> tuple[int, str, list[tuple[object, int, str]]]:
        """Takes what follows ``at`` out of ``chunks``, with ``flush`` beyond gaps too."""
        pieces = []
        for start in sorted(chunks):
            if start > at and not flush:
                break
            if start > at:
                at, tail = start, ""
            new = chunks.pop(start)[at - start :]  # bases that came before are not read again
            if new:
                pieces.append((read, at - len(tail), tail + new))
                at, tail = at + len(new), (tail + new)[-(self.k - 1) :]
        return at, tail, pieces

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        came: dict[object, list[tuple]] = {}
        for frame in rows:
            for read, *chunk in zip(frame["query_id"], frame["start"], frame["seq"], frame["ts"]):
                came.setdefault(read, []).append(chunk)
        first, out, waiting = None, [], self._waiting()
        for read, new in came.items():
            at, tail, count, due = self.come.getValue((read,)) or (0, "", 0, 0)
            old = waiting.get(read, {}) if count else {}
            chunks = dict(old)
            for start, seq, ts in new:
                due = max(due, int(ts.timestamp() * 1000) + self.hold_ms)
                if seq is not None and len(seq) > len(chunks.get(start, "")):
                    chunks[int(start)] = seq
            at, tail, pieces = self._follow(read, at, tail, chunks, flush=False)
            for start in old.keys() - chunks.keys():
                self.waiting.removeKey((read, start))
            for start, seq in chunks.items():
                if old.get(start) != seq:
                    self.waiting.updateValue((read, start), (seq,))
            self.come.updateValue((read,), (at, tail, len(chunks), due))
            first = due if first is None else min(first, due)
            out += pieces
        if first is not None:
            self._wake(first)
        yield self._out(out)

    def _wake(self, due: int) -> None:
        """The next look at what is over: one timer at a time."""
        timer = self.timer.get()
        if timer is not None and timer[0] <= due:
            return
        if timer is not None:
            self.handle.deleteTimer(timer[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, later, out = timerValues.getCurrentWatermarkInMs(), None, []
        self.timer.clear()
        waiting = self._waiting()
        for (read,), (at, tail, count, due) in list(self.come.iterator()):
            if due > now:
                later = due if later is None else min(later, due)
                continue
            chunks = waiting.get(read, {}) if count else {}
            for start in chunks:
                self.waiting.removeKey((read, start))
            self.come.removeKey((read,))
            out += [*self._follow(read, at, tail, chunks, flush=True)[2], (read, -1, "N" * self.k)]
        if later is not None:
            self._wake(later)
        yield self._out(out)

    def close(self) -> None:
        pass


class LastHit(StatefulProcessor):
    """Windows of reads with ``is_extension``: the state is each read's last window and its hit, until the read is over."""

    FIELDS = ("pos", "string_id", "kmer_offset", "orientation")

    def __init__(self, id_kind: str) -> None:
        self.id_kind = id_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", f"query_id {self.id_kind}", "pos long, string_id long, kmer_offset long, orientation long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["query_id", "pos"], kind="stable").reset_index(drop=True)
        read, names = got["query_id"].to_numpy(), got["query_id"].tolist()
        # Nulls are not equal to anything, so no window follows or is followed by one without a hit.
        own = {f: got[f].to_numpy(float) for f in self.FIELDS}
        before = {f: np.r_[np.nan, v[:-1]] for f, v in own.items()}
        starts = np.flatnonzero(np.r_[True, read[1:] != read[:-1]])
        ends = np.append(starts[1:], len(got))
        overs = np.add.reduceat(own["pos"] < 0, starts)
        final = zip(*([None if x != x else int(x) for x in own[f][ends - 1].tolist()] for f in self.FIELDS))
        for lo, hi, over, end in zip(starts.tolist(), ends.tolist(), overs.tolist(), final):
            state = self.last.getValue((names[lo],)) if lo + over < hi or over else None
            if lo + over < hi and state is not None:
                for f, v in zip(self.FIELDS, state):
                    before[f][lo + over] = np.nan if v is None else v
            elif lo + over < hi:
                for f in self.FIELDS:
                    before[f][lo + over] = np.nan
            if over:
                if state is not None:
                    self.last.removeKey((names[lo],))
            else:
                self.last.updateValue((names[lo],), end)
        follows = (before["pos"] + 1 == own["pos"]) & (before["string_id"] == own["string_id"]) & (before["orientation"] == own["orientation"]) & (before["kmer_offset"] + own["orientation"] == own["kmer_offset"])
        yield got.assign(is_extension=follows)[own["pos"] >= 0]

    def close(self) -> None:
        pass


class _Entries:
    """A map state whose entries are one value of the store: read once and written once a call, not once an entry."""

    def __init__(self, value: ValueState) -> None:
        self.value = value

    def load(self) -> None:
        held = self.value.get()
        self.held, self.changed = pickle.loads(held[0]) if held is not None else {}, False

    def store(self) -> None:
        if self.changed and self.held:
            self.value.update((pickle.dumps(self.held, pickle.HIGHEST_PROTOCOL),))
        elif self.changed:
            self.value.clear()

    def getValue(self, key: tuple) -> tuple | None:
        return self.held.get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.held[key], self.changed = value, True

    def removeKey(self, key: tuple) -> None:
        del self.held[key]
        self.changed = True

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(self.held.items())


class Whole(StatefulProcessor):
    """A processor whose map states are kept whole, a value for each bucket of reads.

    A call to the state store costs about a millisecond, whatever it brings, so a call for each read costs far more than
    the scan.  A bucket's value is written anew by each call, so there have to be enough buckets to keep it small.
    """

    def __init__(self, inner: StatefulProcessor) -> None:
        self.inner = inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.maps = handle, []
        self.inner.init(self)

    def getMapState(self, name: str, key: str, value: str) -> _Entries:
        self.maps.append(_Entries(self.handle.getValueState(name, "entries binary")))
        return self.maps[-1]

    def getValueState(self, name: str, schema: str) -> ValueState:
        return self.handle.getValueState(name, schema)

    def registerTimer(self, due: int) -> None:
        self.handle.registerTimer(due)

    def deleteTimer(self, due: int) -> None:
        self.handle.deleteTimer(due)

    def _held(self, call: Callable[..., Iterator[pd.DataFrame]], *args: object) -> Iterator[pd.DataFrame]:
        for m in self.maps:
            m.load()
        yield from call(*args)
        for m in self.maps:
            m.store()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return self._held(self.inner.handleInputRows, key, rows, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._held(self.inner.handleExpiredTimer, key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.inner.close()


def chunk_scan(chunks: DataFrame, index: DataFrame, k: int, canonical_mode: bool = False, late: str = "10 minutes", hold_minutes: int = 10, buckets: int = 256, columns: list[str] | None = None) -> DataFrame:
    """The scan of reads that arrive in chunks: ``query_id, start`` (of the chunk's first base in its read, from 0), ``seq`` and ``ts``.

    Gives what ``scan.with_extension`` gives for whole reads, windows and extensions across chunks included.
    Chunks of a read may come in any order and more than once.  A read is over once the watermark, ``late``
    behind the greatest ``ts``, has passed its greatest ``ts`` by ``hold_minutes``; all its state goes then.  Chunks
    that come behind the watermark are dropped and counted in the query's progress; a chunk whose
    predecessor never came is looked up at the read's end, without windows across the gap, as is one that comes
    after the end but before the watermark.  Reads are dealt over ``buckets`` by a hash, and a bucket's state is one value a map.  ``columns`` are the answer's
    to be given besides ``query_id, pos`` and what an extension is told by (all by default): each costs its way through the state.  The state is kept in RocksDB, the one store that serves timers.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(buckets)).cast("int").alias("_bucket")
    rows = chunks.select(bucket, "query_id", F.col("start").cast("long").alias("start"), "seq", "ts").filter("start IS NOT NULL").withWatermark("ts", late)
    kind = chunks.schema["query_id"].dataType.simpleString()
    pieces = rows.groupBy("_bucket").transformWithStateInPandas(Whole(Pieces(k, hold_minutes * 60_000, kind)), f"_bucket int, query_id {kind}, start long, seq string", "append", "EventTime")
    found = lookup_windows(pieces.drop("_bucket"), index, k, canonical_mode).withColumn("pos", (F.col("pos") + F.when(F.col("start") < 0, F.lit(-1)).otherwise(F.col("start"))).cast("long")).drop("start")
    if columns is not None:
        found = found.select("query_id", *dict.fromkeys([*LastHit.FIELDS, *columns]))
    schema = StructType([*(StructField(f.name, f.dataType) for f in found.schema), StructField("is_extension", BooleanType())])
    return found.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(Whole(LastHit(kind)), schema, "append", "None")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that has arrived, writing Parquet exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def window_counts(scan: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Found and missed windows by event time (column ``ts``), late rows dropped after the watermark."""
    timed = scan.withWatermark("ts", late).groupBy(F.window("ts", window))
    return timed.agg(F.count_if(F.col("found")).alias("found"), F.count_if(~F.col("found")).alias("missed"))
