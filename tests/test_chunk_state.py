"""The state of chunked reads, with the store's calls counted."""

import pandas as pd

from strandloom.streaming.reads import Pieces


class Store(dict):
    passes = 0

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        self.passes += 1
        return iter(list(self.items()))


class Timer:
    due = None

    def getValueState(self, *_):
        return self

    def get(self):
        return self.due

    def update(self, due):
        self.due = due

    def registerTimer(self, due):
        pass


def test_waiting_chunks_are_read_once_a_call():
    """each read went through the waiting chunks of all reads of its bucket."""
    stores = []
    handle = Timer()
    handle.getMapState = lambda *_: stores.append(Store()) or stores[-1]
    pieces = Pieces(3, 1000, "bigint")
    pieces.init(handle)
    ts = pd.Timestamp("2024-01-01")

    def send(start, seq):
        rows = pd.DataFrame([(i, start, seq, ts) for i in range(50)], columns=["query_id", "start", "seq", "ts"])
        return pd.concat(pieces.handleInputRows((0,), iter([rows]), None))

    assert len(send(8, "TTTT")) == 0 and len(stores[1]) == 50
    before = stores[1].passes
    assert len(send(4, "GGGG")) == 0 and stores[1].passes == before + 1 and len(stores[1]) == 100
    got = send(0, "ACAC")
    assert stores[1].passes == before + 2 and not stores[1]
    assert got[got["query_id"] == 7][["start", "seq"]].values.tolist() == [[0, "ACAC"], [2, "ACGGGG"], [6, "GGTTTT"]]
