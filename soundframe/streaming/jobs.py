"""Structured Streaming jobs. Each has a batch twin: `signal.takes`, `features.recording_chunks`, `session_takes`, `catalog.first_of_bursts` and
`signal.smooth`, or the same function on a static table; both give the same rows (open takes and sessions are only given out when a later
row closes them). `armed_takes` and `recording_chunks` keep state in RocksDB, which `with_rocksdb` turns on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from soundframe.operators import catalog, features, maintain
from soundframe.sources.audio import EXTENSIONS


def session_takes(levels: DataFrame, threshold: float, silence: str) -> DataFrame:
    """Takes per device: loud readings less than `silence` apart are one session, from its first to its last.

    signal.takes measures silence by the quiet readings and may so end a take earlier or later by the time between two readings.
    """
    loud = levels.where(F.col("peak_db") > threshold)
    s = loud.groupBy("device_id", F.session_window("ts", silence).alias("w")).agg(F.max("ts").alias("ended_at"), F.count("*").alias("loud_readings"))
    return s.select("device_id", F.col("w.start").alias("started_at"), "ended_at", "loud_readings")


def level_takes(levels: DataFrame, threshold: float, silence: str, late: str = "10 minutes") -> DataFrame:
    """session_takes of a stream."""
    return session_takes(levels.withWatermark("ts", late), threshold, silence)


def with_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TakeTimer(StatefulProcessor):
    """Takes of one device: readings wait until the watermark has passed them, and are then worked off in order of time.

    One timer per device stands at its earliest waiting reading. State: the readings that wait, and what is known of the take that is open.
    """

    def __init__(self, device: str, threshold: float, silence_s: float):
        self.device, self.threshold, self.silence = device, threshold, int(round(silence_s * 1_000_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, peak_db double")
        self.open = handle.getValueState("open", "take long, started long, ended long, loud long, quiet long, stopped boolean, timer long")

    def known(self) -> list:
        return list(self.open.get()) if self.open.exists() else [0, None, None, 0, None, False, None]

    def wake(self, state: list, us: int | None) -> None:
        """The timer at the first whole millisecond from us on."""
        if state[6] is not None:
            self.handle.deleteTimer(state[6])
        state[6] = None if us is None else -(-us // 1000)
        if state[6] is not None:
            self.handle.registerTimer(state[6])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows)
        us = new["ts"].astype("datetime64[us]").astype("int64")
        self.waiting.appendList(list(zip(us.tolist(), new["event_id"].tolist(), new["peak_db"].astype(float).tolist(), strict=True)))
        state, first = self.known(), int(us.min())
        if state[6] is None or -(-first // 1000) < state[6]:
            self.wake(state, first)
        self.open.update(tuple(state))
        yield self.table(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        state, out = self.known(), []
        state[6] = None  # it has gone off
        for us, _, peak in (r for r in rows if r[0] <= passed):
            if peak is not None and peak > self.threshold:
                state[1:6] = [us if state[1] is None else state[1], us, state[3] + 1, None, False]
                continue
            state[4] = us if state[4] is None else state[4]
            if not state[5] and us - state[4] >= self.silence:  # once for each silence
                if state[1] is not None:
                    out.append(tuple(state[:4]))
                state[:6] = [state[0] + 1, None, None, 0, state[4], True]
        left = [r for r in rows if r[0] > passed]
        self.waiting.put(left) if left else self.waiting.clear()
        self.wake(state, left[0][0] if left else None)
        self.open.update(tuple(state))
        yield self.table(key, out)

    def table(self, key, takes: list) -> pd.DataFrame:
        at = lambda k: pd.to_datetime(pd.Series([t[k] for t in takes], dtype="int64"), unit="us")
        return pd.DataFrame({self.device: pd.Series([key[0]] * len(takes)), "take": pd.Series([t[0] for t in takes], dtype="int64"), "started_at": at(1), "ended_at": at(2), "loud_readings": pd.Series([t[3] for t in takes], dtype="int64")})

    def close(self) -> None:
        pass


def armed_takes(levels: DataFrame, threshold: float, silence_s: float, late: str = "10 minutes") -> DataFrame:
    """(device_id, take, started_at, ended_at, loud_readings) of a stream of levels (device_id, event_id, ts, peak_db): the rows of `signal.takes`.

    A take is given out once it is known to be over, that is when the watermark passes the reading that makes its silence long enough.
    Readings that come up to `late` after later ones count in their place; those that come later still are dropped, as by any watermark.
    """
    kind = dict(levels.dtypes)["device_id"]
    stream = levels.select("device_id", "event_id", "ts", "peak_db").withWatermark("ts", late)
    return stream.groupBy("device_id").transformWithStateInPandas(TakeTimer("device_id", threshold, silence_s), f"device_id {kind}, take long, started_at timestamp, ended_at timestamp, loud_readings long", "Append", "EventTime")


class ChunkKeeper(StatefulProcessor):
    """Cuts what a device sends into chunks; what does not fill one waits for the next batch."""

    def __init__(self, device: str, rate: float, size: int):
        self.device, self.rate, self.size = device, rate, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "chunk long, pcm array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunk, rest = self.rest.get() if self.rest.exists() else (0, [])
        new = pd.concat(rows).sort_values("seq")["pcm"]
        x = np.concatenate([np.asarray(rest, float), *[np.asarray(p, float) for p in new if p is not None]])
        full = x[: len(x) // self.size * self.size].reshape(-1, self.size)
        self.rest.update((chunk + len(full), x[full.size :].tolist()))
        yield pd.DataFrame({self.device: [key[0]] * len(full), "chunk": np.arange(chunk, chunk + len(full)), "peak": np.abs(full).max(1) if len(full) else [], "centroid": [features.magnitude_centroid(c, self.rate) for c in full]})

    def close(self) -> None:
        pass


def recording_chunks(pieces: DataFrame, rate: float, size: int = 2048) -> DataFrame:
    """(device_id, chunk, peak, centroid) of a stream of sound (device_id, seq, pcm) that comes in order of seq: full chunks of size samples.

    Pieces may be of any length; chunks that cross them, or batches, are those of the whole recording (`features.recording_chunks`).
    """
    kind = dict(pieces.dtypes)["device_id"]
    return pieces.select("device_id", "seq", F.col("pcm").cast("array<double>").alias("pcm")).groupBy("device_id").transformWithStateInPandas(ChunkKeeper("device_id", rate, size), f"device_id {kind}, chunk long, peak double, centroid double", "Append", "None")


def chunk_peaks(levels: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Peaks of tumbling windows per device: the growing waveform."""
    w = levels.withWatermark("ts", late).groupBy("device_id", F.window("ts", window).alias("w")).agg(F.max("peak_db").alias("peak_db"), F.count("*").alias("readings"))
    return w.select("device_id", F.col("w.start").alias("chunk_start"), "peak_db", "readings")


def latest_status(events: DataFrame) -> DataFrame:
    """Latest status per job (update mode on a stream)."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def debounce(events: DataFrame, key: str, idle_s: float) -> DataFrame:
    """(key, event_id, ts): first events of bursts of a stream (key, event_id, ts); the state of a key is when it was last seen."""
    kind = dict(events.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        before = rows["ts"].shift(1)
        if last is not None and len(rows):
            before.iloc[0] = last
        state.update((int(max(rows["ts"].max(), last or rows["ts"].max()).value // 1000),))
        first = before.isna() | ((rows["ts"] - before).dt.total_seconds() >= idle_s)
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"][first], "ts": rows["ts"][first]})

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, ts timestamp", "seen long", "append", GroupStateTimeout.NoTimeout)


def smooth_levels(levels: DataFrame, attack: float = 0.5, decay: float = 0.1, start: float = -96.0) -> DataFrame:
    """(device_id, smoothed_db, readings) after each batch of a stream of levels (device_id, event_id, ts, peak_db), in update mode."""
    kind = dict(levels.dtypes)["device_id"]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (start, 0)
        for x in pd.concat(batches).sort_values(["ts", "event_id"])["peak_db"]:
            value, n = value + (x - value) * (attack if x > value else decay), n + 1
        state.update((float(value), int(n)))
        yield pd.DataFrame({"device_id": [k[0]], "smoothed_db": [value], "readings": [n]})

    return levels.select("device_id", "event_id", "ts", "peak_db").groupBy("device_id").applyInPandasWithState(run, f"device_id {kind}, smoothed_db double, readings long", "value double, n long", "update", GroupStateTimeout.NoTimeout)


def watch_folder(spark: SparkSession, path: str, catalogue: str, checkpoint: str, trigger: dict | None = None):
    """Appends new audio files under path to the Parquet catalogue; paths that it has are skipped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(path)
    name = catalog.basename(F.col("path"))
    audio = files.where(catalog.extension(F.col("path")).isin(EXTENSIONS) & ~catalog.excluded(name, catalog.DEFAULT_EXCLUDES)).select("path", "length")

    def append(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema("id bigint, path string, length bigint, source_type string").parquet(catalogue)
        new = maintain.ingest(known.select("id", "path"), batch, "watched")
        new.select("id", "path", "length", "source_type").write.mode("append").parquet(catalogue)

    return audio.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
