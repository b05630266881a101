"""Stream operators with keyed state and event-time timers: what a key is remembered by goes when the watermark has passed it.

Rows later than the watermark are dropped. Every operator gives the rows that its batch form gives over the same records.
They need the RocksDB state store, which they set in a session that still has Spark's default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .mutations import ECHO_MS, GAP_MS, MOST

_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = np.iinfo(np.int64).min


def _with_store(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _only_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The key's one timer."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if at is not None:
        handle.registerTimer(int(at))


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


class _Echoes(StatefulProcessor):
    """Of a path, operation and name of a page: when each source told of it last, and which of them leads."""

    def __init__(self, tolerance: int, columns: list[str]) -> None:
        self.tolerance, self.columns = tolerance, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "cdp long, js long, cdp_leads boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _sorted(rows, "ts_ms", "n")
        cdp, at = (df["source"] == "cdp").to_numpy(), df["ts_ms"].to_numpy(np.int64)
        had = self.last.get() if self.last.exists() else (_NEVER, _NEVER, None)

        def before(own: np.ndarray, first: int) -> np.ndarray:
            return np.maximum.accumulate(np.concatenate([[first], np.where(own, at, _NEVER)]))

        last = before(cdp, had[0]), before(~cdp, had[1])
        other = np.where(cdp, last[1][:-1], last[0][:-1])
        alone = (other == _NEVER) | (at - np.where(other == _NEVER, at, other) > self.tolerance)
        place = np.maximum.accumulate(np.where(alone, np.arange(len(df)), -1))
        leads = np.where(place >= 0, cdp[np.maximum(place, 0)], bool(had[2]))
        self.last.update((int(last[0][-1]), int(last[1][-1]), bool(leads[-1])))
        _only_timer(self.handle, at[-1] + self.tolerance + 1)
        yield df.loc[~cdp | leads, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()  # the next record leads anyway
        return iter(())

    def close(self) -> None:
        pass


def remove_echoes(stream: DataFrame, late: str = "10 seconds", tolerance: int = ECHO_MS, time: str = "ts") -> DataFrame:
    """A stream without records of the browser protocol that the page's own script has told within the tolerance: the rule of mutations.drop_echoes_batch.

    stream: page_id, ts_ms, n, source, xpath, op, name, what else there is, and the event time.
    """
    _with_store(stream.sparkSession)
    keys, columns = ["page_id", "xpath", "op", "name"], [c for c in stream.columns if c != time]
    filled = stream.withColumn("_name", F.coalesce("name", F.lit(""))).withColumn("_path", F.coalesce("xpath", F.lit(""))).withWatermark(time, late)
    schema = stream.select(*columns).schema
    assert set(keys) <= set(columns)
    return filled.groupBy("page_id", "_path", "op", "_name").transformWithStateInPandas(_Echoes(tolerance, columns), schema, "append", "EventTime")


class _Flush(StatefulProcessor):
    """Of a page: the records of the batch that is still open."""

    def __init__(self, columns: list[str], kinds: str, gap: int, most: int) -> None:
        self.columns, self.kinds, self.gap, self.most = columns, kinds, gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", self.kinds)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=self.columns)

    def _batches(self, df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Where batches begin, and which batch each record is in."""
        at, i = df["ts_ms"].to_numpy(np.int64), np.arange(len(df))
        fresh = np.concatenate([[True], np.diff(at) >= self.gap])
        start = np.maximum.accumulate(np.where(fresh, i, 0))
        first = fresh | ((i - start) % self.most == 0)
        return np.flatnonzero(first), np.cumsum(first) - 1

    def _out(self, df: pd.DataFrame, first: np.ndarray, batch: np.ndarray) -> pd.DataFrame:
        return df.assign(batch_ms=df["ts_ms"].to_numpy()[first[batch]], batch_n=df["n"].to_numpy()[first[batch]])[[*self.columns, "batch_ms", "batch_n"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[self.columns]
        held = self._held()
        df = _sorted([held.astype(new.dtypes) if len(held) else new.iloc[:0], new], "ts_ms", "n")
        first, batch = self._batches(df)
        whole = len(df) - first[-1] == self.most
        done = np.ones(len(df), bool) if whole else batch < batch[-1]
        rest = df[~done]
        self.held.clear()
        if len(rest):
            self.held.put([tuple(None if pd.isna(x) else x for x in r) for r in rest.astype(object).itertuples(index=False, name=None)])
        _only_timer(self.handle, int(rest["ts_ms"].iloc[-1]) + self.gap if len(rest) else None)
        yield self._out(df, first, batch)[done]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        df = self._held()
        self.held.clear()
        if len(df):
            yield self._out(df, *self._batches(df))

    def close(self) -> None:
        pass


def flush(stream: DataFrame, late: str = "10 seconds", gap_ms: int = GAP_MS, most: int = MOST, time: str = "ts") -> DataFrame:
    """Records of batches that have ended, by gap_ms of quiet or by `most` records, with the first record's ts_ms and n (batch_ms, batch_n): the batches of mutations.quiet_batches.

    A full batch is handed on at once; a quiet one when the watermark has passed its end. A page holds fewer than `most`
    records. stream: page_id, ts_ms, n, what else there is, and the event time.
    """
    _with_store(stream.sparkSession)
    columns = [c for c in stream.columns if c != time]
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)
    out = f"{kinds}, batch_ms long, batch_n {stream.schema['n'].dataType.simpleString()}"
    return stream.withWatermark(time, late).groupBy("page_id").transformWithStateInPandas(_Flush(columns, kinds, gap_ms, most), out, "append", "EventTime")


class _AsOf(StatefulProcessor):
    """Of a page: batches that wait for the watermark, and snapshots that one of them or a later one may refer to."""

    _KIND = "id string, timestamp long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.snapshots = handle.getListState("waiting", self._KIND), handle.getListState("snapshots", self._KIND)

    @staticmethod
    def _rows(state) -> list[tuple]:
        return list(state.get()) if state.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        for state, part in ((self.waiting, df[~df["is_snapshot"]]), (self.snapshots, df[df["is_snapshot"]])):
            if len(part):
                state.appendList(list(part[["id", "timestamp"]].astype(object).itertuples(index=False, name=None)))
        self._remind(self._rows(self.waiting), self._rows(self.snapshots))
        return iter(())

    def _remind(self, waiting: list[tuple], snapshots: list[tuple]) -> None:
        # the last timer of a page, after its batches, lets a snapshot go that a newer one has replaced
        at = min((t for _, t in waiting), default=None)
        if at is None and len(snapshots) > 1:
            at = sorted(t for _, t in snapshots)[1]
        _only_timer(self.handle, None if at is None else at + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, snapshots = sorted(self._rows(self.waiting), key=lambda r: (r[1], r[0])), sorted(self._rows(self.snapshots), key=lambda r: (r[1], r[0]))
        ready = [r for r in waiting if r[1] < passed]
        at = np.searchsorted(np.array([t for _, t in snapshots], np.int64), np.array([t for _, t in ready], np.int64), "right") - 1
        out = pd.DataFrame({"page_id": [key[0]] * len(ready), "id": [i for i, _ in ready], "timestamp": [t for _, t in ready], "snapshot_ref": [snapshots[j][0] if j >= 0 else None for j in at]})
        waiting = [r for r in waiting if r[1] >= passed]
        old = [r for r in snapshots if r[1] < passed]
        snapshots = old[-1:] + [r for r in snapshots if r[1] >= passed]
        for state, rows in ((self.waiting, waiting), (self.snapshots, snapshots)):
            state.clear()
            if rows:
                state.put(rows)
        self._remind(waiting, snapshots)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def as_of_snapshots(batches: DataFrame, snapshots: DataFrame, late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """page_id, id, timestamp, snapshot_ref: each batch of a stream with its page's last snapshot at or before it, of another stream, as mutations.with_snapshots gives them.

    A batch waits until the watermark has passed it, so a snapshot counts if it comes no later than `late` after newer
    rows; later ones are dropped, and the batch refers to the one before. Of snapshots that have been replaced before the
    watermark, the newest is kept. Both streams: page_id, id, timestamp (ms) and the event time.
    """
    _with_store(batches.sparkSession)
    both = batches.select("page_id", "id", "timestamp", time, F.lit(False).alias("is_snapshot")).unionByName(snapshots.select("page_id", "id", "timestamp", time, F.lit(True).alias("is_snapshot")))
    return both.withWatermark(time, late).groupBy("page_id").transformWithStateInPandas(_AsOf(), "page_id string, id string, timestamp long, snapshot_ref string", "append", "EventTime")
