"""the state of chunked reads is one value a bucket, so calls to the store do not grow with the reads."""

from types import SimpleNamespace

import pandas as pd

from strandloom.streaming.reads import LastHit, Pieces, Whole


class Handle:
    """A state store whose calls are counted."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getValueState(self, name, schema):
        def called(f):
            def call(*args):
                self.calls += 1
                return f(*args)

            return call

        return SimpleNamespace(get=called(lambda: self.held.get(name)), update=called(lambda v: self.held.__setitem__(name, v)), clear=called(lambda: self.held.pop(name, None)))

    def registerTimer(self, due):
        self.calls += 1

    deleteTimer = registerTimer


def test_calls_do_not_grow_with_reads():
    ts, calls = pd.Timestamp("2024-01-01"), []
    for reads in (3, 300):
        handle, pieces = Handle(), Whole(Pieces(3, 1000, "bigint"))
        pieces.init(handle)
        for start, seq in ((4, "GGGG"), (0, "ACAC")):
            frame = pd.DataFrame([(i, start, seq, ts) for i in range(reads)], columns=["query_id", "start", "seq", "ts"])
            got = pd.concat(pieces.handleInputRows((0,), iter([frame]), None))
        assert got[got["query_id"] == 2][["start", "seq"]].values.tolist() == [[0, "ACAC"], [2, "ACGGGG"]] and len(got) == 2 * reads
        over = pd.concat(pieces.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1 << 60), None))
        assert (over["start"] == -1).all() and len(over) == reads and set(handle.held) == set()
        calls.append(handle.calls)
    assert calls[0] == calls[1] < 20


def test_last_hits_outlive_a_call():
    handle, last = Handle(), Whole(LastHit("bigint"))
    last.init(handle)

    def send(*rows):
        frame = pd.DataFrame(rows, columns=["query_id", "pos", "string_id", "kmer_offset", "orientation"])
        return pd.concat(last.handleInputRows((0,), iter([frame]), None)).sort_values(["query_id", "pos"])["is_extension"].tolist()

    assert send((1, 1, 0, 11, 1), (1, 0, 0, 10, 1), (2, 0, 0, 50, -1), (3, 0, None, None, None)) == [False, True, False, False]
    assert send((1, 2, 0, 12, 1), (2, 1, 0, 49, -1), (3, 1, None, None, None), (2, 2, 0, 49, -1)) == [True, True, False, False]
    assert send((1, -1, None, None, None), (2, -1, None, None, None), (3, -1, None, None, None)) == [] and not handle.held
