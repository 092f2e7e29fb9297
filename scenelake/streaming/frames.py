"""Frames that arrive as a stream: sampling, windows, and counts of frames that are assembled from pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from scenelake.functions import arrays
from scenelake.operators import whole


def interval_sample(stream: DataFrame, by: str, order: str, step: int, offset: int = 0) -> DataFrame:
    """Every ``step``-th row of each key, counted over all batches; the state is one number a key.

    Rows of a key are ordered within a batch; batches count in the order of their arrival.
    """
    schema: StructType = stream.schema

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        place = np.arange(seen, seen + len(rows)) + offset
        state.update((seen + len(rows),))
        yield rows[place % step == 0]

    return stream.groupBy(by).applyInPandasWithState(run, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def hopping_counts(df: DataFrame, by: str, time: str, size: str, hop: str, late: str | None = None) -> DataFrame:
    """Rows and first id of each key in windows that start every ``hop``; ``late`` sets the watermark of a stream."""
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(by, F.window(time, size, hop)).agg(F.count("*").alias("n"), F.min(time).alias("first"))
    return out.select(by, F.col("window.start").alias("start"), "n", "first")


def frame_counts(stream: DataFrame, height: int, width: int, threshold: float = 0.1, rtol: float = 0.03, late: str = "1 minute", degrees: float = 5.0) -> DataFrame:
    """scene, frame, n_valid, n_accepted, n_edge, n_normal, n_final, complete for frames put together from pixels
    (scene, frame, ts, v, u, d, conf and, for the normal and final edges, lx and ly; without them these are null).

    A frame is counted when its last pixel has come, or as incomplete once the watermark has passed its latest time by
    ``late``. Its state holds its height * width pixels, and after it was counted only that it was, until the watermark
    has passed; pixels that come again change nothing. Null depths, confidences and coordinates count as 0; of pixels
    that come twice the last counts; those outside of the frame and without a time are dropped.
    """
    out = "scene long, frame long, n_valid long, n_accepted long, n_edge long, n_normal long, n_final long, complete boolean"
    held = "at array<long>, values array<double>, last long, counted boolean"
    pointed = {"lx", "ly"} <= set(stream.columns)
    wanted = ["d", "conf", *(["lx", "ly"] if pointed else [])]

    def result(key: tuple, at: list, values: list) -> pd.DataFrame:
        table = np.zeros((height * width, len(wanted)))
        table[at] = np.array(values, float).reshape(-1, len(wanted))
        d, sure = table[:, 0].reshape(height, width), table[:, 1].reshape(height, width)
        valid, edge = d > 0, arrays.depth_edges(d, rtol)
        n_normal = n_final = None
        if pointed:
            normal = arrays.normal_edges(np.stack([table[:, 2].reshape(height, width), table[:, 3].reshape(height, width), d], 2), valid, degrees)
            n_normal, n_final = int((normal & valid).sum()), int((normal & edge & valid).sum())
        row = (*key, int(valid.sum()), int((valid & (sure > threshold)).sum()), int((edge & valid).sum()), n_normal, n_final, len(set(at)) == height * width)
        return pd.DataFrame([row], columns=["scene", "frame", "n_valid", "n_accepted", "n_edge", "n_normal", "n_final", "complete"]).astype({"n_normal": "Int64", "n_final": "Int64"})

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, values, last, counted = (list(state.get[0]), list(state.get[1]), state.get[2], state.get[3]) if state.exists else ([], [], 0, False)
        if state.hasTimedOut:
            state.remove()
            if not counted:
                yield result(key, at, values)
            return
        for p in parts:
            p = p[(p["v"] >= 0) & (p["v"] < height) & (p["u"] >= 0) & (p["u"] < width)]
            if len(p):
                last = max(last, int(p["ts"].max().timestamp() * 1000))
                at += (p["v"] * width + p["u"]).astype(int).tolist()
                values += p[wanted].fillna(0.0).to_numpy(float).ravel().tolist()
        done = not counted and len(set(at)) == height * width
        if counted or done:
            state.update(([], [], last, True))
        else:
            state.update((at, values, last, False))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if done:
            yield result(key, at, values)

    stream = stream.where("ts IS NOT NULL").select("scene", "frame", "ts", "v", "u", *wanted).withWatermark("ts", late)
    return stream.groupBy("scene", "frame").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def count_whole_frames(stream: DataFrame, path: str, checkpoint: str, height: int, width: int, rtol: float = 0.03, degrees: float = 5.0) -> StreamingQuery:
    """Starts a query that counts the edges of frames that arrive as rows with arrays (whole.edge_counts) and writes the
    counts of each batch under ``path``, in a folder of the batch's number.

    A batch that runs again, after a failure before its commit, replaces its own folder and no other, so each batch is
    there once. Frames that come again in a later batch are counted again. All that is there is one Parquet table.
    """

    def write(batch: DataFrame, number: int) -> None:
        whole.edge_counts(batch, height, width, rtol, degrees).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
