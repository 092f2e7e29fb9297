"""Stencils over tables with a row a frame, its pixels held as arrays by rows: no shuffle, and four products a pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from scenelake.functions import arrays

#: Pixels that are worked on at once; the stencils take about 260 bytes for each.
PIXELS = 1 << 16
COUNTS = ("n_valid", "n_depth", "n_normal", "n_final")


def _grids(column: pa.Array, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(height, width, rows) of the lists of a column, and which rows have a list of that size; others are NaN."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(np.array(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), float), nan=-1)
    good = sizes == height * width
    out = np.full((len(lists), height * width), np.nan)
    if good.any():
        kept = lists.filter(pa.array(good)).flatten()
        out[good] = kept.to_numpy(zero_copy_only=False).reshape(-1, height * width)
    return np.moveaxis(out.reshape(-1, height, width), 0, -1), good


def frame_edges(frames: DataFrame, height: int, width: int, rtol: float = 0.03, degrees: float = 5.0) -> DataFrame:
    """scene, frame, depth_edge, normal_edge, edge (arrays of flags) and n_valid, n_depth, n_normal, n_final of frames
    with arrays d, lx, ly, lz, by rows: the same as masks.edges and masks.edge_counts of their pixels.

    A pixel is valid where its depth d is positive; null and NaN depths are not, null coordinates count as NaN. A frame
    whose depths are null or not height * width many has no valid pixel. Rows that repeat a frame are frames of their
    own. Frames of other columns keep none of them.
    """
    scene, frame = (dict(frames.dtypes)[c] for c in ("scene", "frame"))
    flags = ("depth_edge", "normal_edge", "edge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, PIXELS // (height * width))):
                batch = whole.slice(at, max(1, PIXELS // (height * width)))
                (d, _), *xyz = (_grids(batch.column(i), height, width) for i in range(2, 6))
                points = np.stack([g for g, _ in xyz], -1)
                valid = d > 0
                found = {"depth_edge": arrays.depth_edges(np.where(valid, d, 0.0), rtol), "normal_edge": arrays.normal_edges(points, valid, degrees)}
                found["edge"] = found["depth_edge"] & found["normal_edge"]
                counts = [valid, *[found[n] & valid for n in flags]]
                lists = [pa.array(list(np.moveaxis(found[n], -1, 0).reshape(batch.num_rows, -1)), pa.list_(pa.bool_())) for n in flags]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, *[pa.array(c.sum((0, 1)).astype(np.int64)) for c in counts]], names=["scene", "frame", *flags, *COUNTS])

    kind = f"scene {scene}, frame {frame}, " + ", ".join(f"{n} array<boolean>" for n in flags) + ", " + ", ".join(f"{n} long" for n in COUNTS)
    return frames.select("scene", "frame", *[F.col(c).cast("array<double>").alias(c) for c in ("d", "lx", "ly", "lz")]).mapInArrow(run, kind)


def edge_counts(frames: DataFrame, height: int, width: int, rtol: float = 0.03, degrees: float = 5.0) -> DataFrame:
    """scene, frame, n_valid, n_depth, n_normal and n_final of frame_edges."""
    return frame_edges(frames, height, width, rtol, degrees).select("scene", "frame", *COUNTS)


def with_edges(px: DataFrame, height: int, width: int, rtol: float = 0.03, degrees: float = 5.0) -> DataFrame:
    """Pixels, all columns, with depth_edge, normal_edge and edge as masks.edges adds them, frame by frame as arrays.

    One shuffle brings a frame's pixels to a task, which holds height * width of them; masks.edges needs no size and
    sorts its windows nine times instead. Pixels without a place in the frame have no edge and are no neighbours; of
    pixels that repeat a place the last one given is seen. Null flags and depths that are null or not positive are not
    valid. Columns of these names are replaced.
    """
    flags = ("depth_edge", "normal_edge", "edge")
    px = px.drop(*flags)

    def run(table: pa.Table) -> pa.Table:
        number = lambda c: table[c].cast(pa.float64()).to_numpy()
        v, u = np.nan_to_num(number("v"), nan=-1).astype(np.int64), np.nan_to_num(number("u"), nan=-1).astype(np.int64)
        inside = (v >= 0) & (v < height) & (u >= 0) & (u < width)
        v, u = v[inside], u[inside]
        d, points, valid = np.zeros((height, width)), np.zeros((height, width, 3)), np.zeros((height, width), bool)
        d[v, u] = np.nan_to_num(number("d")[inside])
        valid[v, u] = table["valid"].fill_null(False).to_numpy()[inside]
        for i, c in enumerate(("lx", "ly", "lz")):
            points[v, u, i] = number(c)[inside]
        valid &= d > 0
        found = [arrays.depth_edges(np.where(valid, d, 0.0), rtol), arrays.normal_edges(points, valid, degrees)]
        for name, flag in zip(flags, [*found, found[0] & found[1]], strict=True):
            out = np.zeros(len(inside), bool)
            out[inside] = flag[v, u]
            table = table.append_column(name, pa.array(out))
        return table

    kind = StructType([*px.schema.fields, *[StructField(n, BooleanType()) for n in flags]])
    return px.groupBy("scene", "frame").applyInArrow(run, kind)
