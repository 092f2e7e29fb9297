"""Chunks of a scene that arrive as a stream, placed by the machine of operators/trajectory.py as time goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from scenelake.operators import trajectory

#: The state store that keyed maps and timers need, and the setting that names it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Stitcher(StatefulProcessor):
    """State of a scene: the number of the next chunk and of late frames, the tail of the last chunk in the scene's
    frame, the frames that wait for their chunk's turn, and a timer for each chunk that waits and for the scene."""

    def __init__(self, inputs: dict[str, str], scorer: Callable | None, options: trajectory.Options, patience: int, idle: int):
        self.inputs, self.scorer, self.options, self.patience, self.idle = inputs, scorer, options, patience, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, late long, last long, ends long")
        self.chunks = handle.getMapState("chunks", "chunk long", "frames long, size long, last long, due long")
        fields = ", ".join(f"`{n}` {t}" for n, t in self.inputs.items())
        self.waiting = handle.getMapState("waiting", "chunk long, frame long", fields)
        self.tail = handle.getMapState("tail", "frame long", ", ".join(f"{n} {t}" for n, t in trajectory.FIELDS.items()))

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        chunk, late, last, ends = self.place.get() if self.place.exists() else (0, 0, -1, -1)
        for part in rows:
            for at, c, f, n, *values in zip(part["ms"], part["chunk"], part["frame"], part["n_frames"], *[part[i] for i in self.inputs], strict=True):
                c, f, at = int(c), int(f), int(at)
                last = max(last, at)
                if c < chunk:
                    late += 1
                    continue
                frames, size, newest, due = self.chunks.getValue((c,)) if self.chunks.containsKey((c,)) else (0, int(n), -1, -1)
                if not self.waiting.containsKey((c, f)):
                    self.waiting.updateValue((c, f), tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in values))
                    frames += 1
                self.chunks.updateValue((c,), (frames, size, max(newest, at), due))
        self._time_chunks(timerValues)
        self.place.update((chunk, late, last, ends))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.place.exists():  # a timer may outlive its scene
            yield from self._advance(key, timerValues)

    def _time_chunks(self, timers: TimerValues) -> None:
        """A timer for every chunk that waits, ``patience`` after its newest frame."""
        for (c,), (frames, size, newest, due) in list(self.chunks.iterator()):
            if newest + self.patience != due:
                if due >= 0:
                    self.handle.deleteTimer(due)
                due = newest + self.patience
                self.chunks.updateValue((c,), (frames, size, newest, due))
        for *_, due in list(self.chunks.values()):  # chunks may share a time, so all that are due are set anew
            self.handle.registerTimer(max(due, timers.getCurrentWatermarkInMs() + 1))

    def _advance(self, key: tuple, timers: TimerValues) -> Iterator[pd.DataFrame]:
        """Places the chunks that are complete, and those up to the last that time has closed, in order."""
        chunk, late, last, ends = self.place.get()
        now = timers.getCurrentWatermarkInMs()
        known = {c: v for (c,), v in self.chunks.iterator()}
        closed = max((c for c, v in known.items() if v[3] <= now), default=-1)
        while chunk <= closed or (chunk in known and known[chunk][0] >= known[chunk][1]):
            chunk = chunk if chunk in known else min(c for c in known if c > chunk)
            yield self._placed(key, chunk, late)
            del known[chunk]
            self.chunks.removeKey((chunk,))
            chunk += 1
        if not known and last + self.idle <= now:  # nothing waits and nothing has come for long: the scene is over
            self.place.clear()
            for state in (self.chunks, self.waiting, self.tail):
                state.clear()
            return
        if not known and ends != last + self.idle:
            if ends >= 0:
                self.handle.deleteTimer(ends)
            ends = last + self.idle
            self.handle.registerTimer(max(ends, now + 1))
        self.place.update((chunk, late, last, ends))

    def _placed(self, key: tuple, chunk: int, late: int) -> pd.DataFrame:
        own = sorted(f for c, f in self.waiting.keys() if c == chunk)
        rows = pd.DataFrame([(f, *self.waiting.getValue((chunk, f))) for f in own], columns=["frame", *self.inputs]).assign(scene=key[0], chunk=chunk)
        before = {f: trajectory.unflat(v) for (f,), v in self.tail.iterator()}
        frames = trajectory.scored(rows, self.scorer, before, self.options) if self.scorer else trajectory.given(rows)
        m, moved, tail = trajectory.placed(frames, before, self.options.overlap, self.options.least)
        self.tail.clear()
        for f, s in tail.items():
            self.tail.updateValue((f,), trajectory.flat(s))
        for f in own:
            self.waiting.removeKey((chunk, f))
        return pd.DataFrame([(key[0], chunk, f, m.ravel().tolist(), *trajectory.flat(s), late) for f, s in moved.items() if f not in before], columns=["scene", "chunk", "frame", "m", *trajectory.FIELDS, "late"])


def stitch(stream: DataFrame, options: trajectory.Options, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None, delay: str = "1 minute", patience: int = 60_000, idle: int = 3_600_000) -> DataFrame:
    """scene, chunk, frame, m, FIELDS of trajectory and late for every frame once, in the frame of chunk 0.

    Rows are whole frames of a chunk: scene, chunk (from 0), frame, n_frames (frames of that chunk), ts, and what
    trajectory.in_order takes. A chunk is placed when the one before is and all its frames have come. What is missing
    is waited for until the watermark, ``delay`` behind the latest time, has passed the newest frame of that chunk or of
    a later one by ``patience`` milliseconds; then the chunks up to that one are placed with the frames they have, and
    those of which nothing has come are passed over. So what comes within that time has its place in any order of
    arrival, and the last chunk of a scene comes out too. A frame of a chunk that is placed already is dropped and
    counted in ``late`` (so far, by scene), and so is one that comes behind the watermark, uncounted. Of frames that
    come twice the first counts. Rows with a null scene, chunk, frame, n_frames or ts are dropped.

    The state of a scene is the frames that wait, the tail of the last chunk and a few numbers; it ends when nothing
    waits and nothing has come for ``idle`` milliseconds of event time. Needs the state store STORE names.
    """
    if idle < patience:
        raise ValueError("a scene cannot end before its chunks do")
    if stream.isStreaming and stream.sparkSession.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    kinds = dict(stream.dtypes)
    names = [c for c in stream.columns if c.startswith("input_")] if scorer else [c for c in ("x", "y", "z", "accepted", "pose") if c in kinds]
    inputs = {c: kinds[c] for c in names}
    out = f"scene {kinds['scene']}, chunk long, frame long, m array<double>, " + ", ".join(f"{n} {t}" for n, t in trajectory.FIELDS.items()) + ", late long"
    rows = stream.select("scene", *[F.col(c).cast("long").alias(c) for c in ("chunk", "frame", "n_frames")], "ts", F.unix_millis("ts").alias("ms"), *names).dropna(subset=["scene", "chunk", "frame", "n_frames", "ts"])
    machine = _Stitcher(inputs, scorer, options, patience, idle)
    return rows.withWatermark("ts", delay).groupBy("scene").transformWithStateInPandas(machine, out, "append", "EventTime")
