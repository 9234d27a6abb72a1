"""Ordered release on a stream: a tile leaves when all before it have arrived.

State is per slide: the next index as a value, and the tiles that wait for it in a map by index, so a batch
touches what arrives and what leaves, whatever else is waiting. What can leave in the batch in which it came
goes in runs, by sorting, and never touches the state. A processing-time timer runs while
tiles wait; if it ends before the next one comes the query fails, and a negative time waits for ever.
When a slide's last tile has left nothing of it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RELEASED = "slide_id string, k bigint, payload binary, place bigint"
#: Tiles that leave together in one frame.
RELEASE_ROWS = 1 << 16
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reorder(StatefulProcessor):
    """State variables: ``following`` (the next index) and ``waiting`` (index to payload)."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.following = handle.getValueState("following", "k bigint")
        self.waiting = handle.getMapState("waiting", "k bigint", "payload binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        first = following = self.following.get()[0] if self.following.exists() else 0
        indices, payloads, n_tiles = [np.empty(0, np.int64)], [np.empty(0, object)], None
        for batch in rows:
            known = batch["n_tiles"].dropna()
            n_tiles = int(known.iloc[0]) if len(known) else n_tiles
            k = batch["k"].to_numpy(np.int64)
            indices.append(k[k >= following])
            payloads.append(batch["payload"].to_numpy(object)[k >= following])
        # in order, of each index the tile that came last
        k = np.concatenate(indices)
        order = np.argsort(k, kind="stable")
        k = k[order]
        last = np.ones(len(k), bool)
        last[:-1] = k[1:] != k[:-1]
        k, payload = k[last], np.concatenate(payloads)[order[last]]
        waits = next(iter(self.waiting.keys()), None) is not None
        ends = np.append(np.flatnonzero(np.diff(k) != 1) + 1, len(k))  # of the runs without gaps
        at, out = 0, []
        while True:
            if at < len(k) and k[at] == following:
                stop = int(ends[np.searchsorted(ends, at, side="right")])
                out.append((k[at:stop], payload[at:stop]))
                if waits:
                    for came in k[at:stop].tolist():
                        if self.waiting.containsKey((came,)):  # it came twice
                            self.waiting.removeKey((came,))
                following, at = following + stop - at, stop
            elif waits and self.waiting.containsKey((following,)):
                held = np.empty(1, object)
                held[0] = bytes(self.waiting.getValue((following,))[0])
                self.waiting.removeKey((following,))
                out.append((np.array([following]), held))
                following += 1
            else:
                break
        come = dict(zip(k[at:].tolist(), map(bytes, payload[at:]), strict=True))
        for k, payload in come.items():
            self.waiting.updateValue((k,), (payload,))
        ended = n_tiles is not None and following >= n_tiles
        if self.timeout_ms >= 0:
            timers = list(self.handle.listTimers())
            if following > first or ended:
                for timer in timers:
                    self.handle.deleteTimer(timer)
                timers = []
            if not ended and not timers and next(iter(self.waiting.keys()), None) is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        if ended:
            self.following.clear()
            self.waiting.clear()
        else:
            self.following.update((following,))
        if out:
            k, payload = (np.concatenate(part) for part in zip(*out, strict=True))
            for at in range(0, len(k), RELEASE_ROWS):
                part = slice(at, at + RELEASE_ROWS)
                yield pd.DataFrame({"slide_id": key[0], "k": k[part], "payload": payload[part], "place": k[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        raise TimeoutError(f"slide {key[0]}: tile {self.following.get()[0]} has not arrived")

    def close(self) -> None:
        pass


def release_in_order(tiles: DataFrame, timeout_ms: int = -1) -> DataFrame:
    """``RELEASED`` of a stream (slide_id, k, payload[, n_tiles]); ``place`` counts what has left, from 0.

    Indices run from 0 without gaps; one that arrives again after it left is dropped. ``n_tiles`` says how many a slide
    has; its state ends with the last one, and a repeat that comes even later waits as the begin of a new slide.
    Without it the state of a slide, one number, stays. The session's state store becomes RocksDB, which this needs.
    """
    tiles.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    n_tiles = F.col("n_tiles").cast("bigint") if "n_tiles" in tiles.columns else F.lit(None).cast("bigint")
    named = tiles.select("slide_id", "k", "payload", n_tiles.alias("n_tiles"))
    mode = "ProcessingTime" if timeout_ms >= 0 else "None"
    return named.groupBy("slide_id").transformWithStateInPandas(Reorder(timeout_ms), RELEASED, "Append", mode)
