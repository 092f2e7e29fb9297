"""Resampling of frames, and the join of a frame's pixels with what another frame sees of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scenelake.functions.naming import keeps_columns
from scenelake.operators.sampling import sides

#: Pixels of moved frames that are worked on at once.
PIXELS = 1 << 18
MODES = ("bilinear", "nearest")


def _targets(c: str, source: int, target: int) -> Column:
    """Target places that a source place serves, with weights: linear between centres, held at the borders."""
    i, step = F.col(c).cast("double"), target / source
    low = F.when(i == 0, 0).otherwise(F.ceil((i - 0.5) * step - 0.5)).cast("long")
    high = F.when(i == source - 1, target - 1).otherwise(F.floor((i + 1.5) * step - 0.5)).cast("long")
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(target - 1))
    at = lambda t: F.least(F.greatest((t + 0.5) / step - 0.5, F.lit(0.0)), F.lit(source - 1.0))
    found = F.transform(F.sequence(low, high), lambda t: F.struct(t.alias("t"), (1 - F.abs(at(t) - i)).alias("w")))
    return F.when(low <= high, F.filter(found, lambda x: x["w"] > 0))


def resample_bilinear(px: DataFrame, source: int | tuple[int, int], target: int | tuple[int, int], value: str = "d") -> DataFrame:
    """scene, frame, tv, tu and the value of frames of another size (height and width, or the side of a square), linear
    with half-pixel centres.

    Each source pixel gives its share, along either axis, to the places around it, so the sums are partly made before
    the shuffle and nothing is joined. Null values count as 0, rows with null keys or outside of the frame give nothing.
    """
    (sv, su), (tv, tu) = sides(source), sides(target)
    px = px.where((F.col("v") >= 0) & (F.col("v") < sv) & (F.col("u") >= 0) & (F.col("u") < su)).select("scene", "frame", "u", F.coalesce(F.col(value), F.lit(0.0)).alias(value), F.explode(_targets("v", sv, tv)).alias("a"))
    px = px.select("scene", "frame", value, "a", F.explode(_targets("u", su, tu)).alias("b"))
    share = F.col("a.w") * F.col("b.w") * F.col(value)
    return px.groupBy("scene", "frame", F.col("a.t").alias("tv"), F.col("b.t").alias("tu")).agg(F.sum(share).alias(value))


def expand_tiles(tiles: DataFrame, side: int, values: str = "values") -> DataFrame:
    """Pixels of tiles (scene, frame, tv, tu, values of side * side places by rows)."""
    out = tiles.select("scene", "frame", "tv", "tu", F.posexplode(values).alias("i", "value"))
    return out.select("scene", "frame", (F.col("tv") * side + F.expr(f"i div {side}")).alias("v"), (F.col("tu") * side + F.col("i") % side).alias("u"), "value")


@keeps_columns
def mask_priors(prior: DataFrame, previous: DataFrame, threshold: float) -> DataFrame:
    """Prior depths, 0 where the earlier chunk's confidence at the same pixel is not above the threshold or unknown."""
    by = ["scene", "frame", "v", "u"]
    seen = prior.join(previous.select(*by, F.col("conf").alias("_conf")), by, "left")
    return seen.withColumn("d", F.when(~F.isnan("_conf") & (F.col("_conf") > threshold), F.col("d")).otherwise(0.0)).drop("_conf")


def _lists(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, size) of lists of numbers, and which rows have such a list without nulls; others are NaN."""
    sizes = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    good, out = sizes == size, np.full((len(column), size), np.nan)
    flat = column.filter(pa.array(good)).flatten()
    out[good] = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    good[good] = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(1)
    return out, good


def _number(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _depths(x: np.ndarray, y: np.ndarray, row: np.ndarray, grid: np.ndarray, mode: str) -> np.ndarray:
    """What grids (rows, height, width) have at places of their rows, 0 outside of them."""
    height, width = grid.shape[1:]
    if mode == "nearest":
        corners = [(np.floor(y), np.floor(x), 1.0)]
    else:
        low, left = np.floor(y - 0.5), np.floor(x - 0.5)
        b, a = y - 0.5 - low, x - 0.5 - left
        corners = [(low, left, (1 - b) * (1 - a)), (low, left + 1, (1 - b) * a), (low + 1, left, b * (1 - a)), (low + 1, left + 1, b * a)]
    out = np.zeros(len(x))
    for v, u, weight in corners:
        inside = (v >= 0) & (v < height) & (u >= 0) & (u < width)
        seen = np.zeros(len(x))
        seen[inside] = grid[row[inside], v[inside].astype(np.int64), u[inside].astype(np.int64)]
        out += weight * seen
    return out


def _moved(px: DataFrame, pairs: DataFrame, k: tuple[float, float, float, float] | DataFrame, height: int, width: int, modes: tuple[str, ...]) -> DataFrame:
    """scene, frame, other, v, u, d, px, py, z and the depth seen at (px, py) by each mode, under the mode's name.

    Pixels are gathered by frame once; a pair joins two such rows, its own frame and the other, so what is shuffled for
    it is the pixels of these. A task holds the pixels of one pair, or of some small ones.
    """
    if isinstance(k, DataFrame):
        own = k.select("scene", "frame", F.col("k").alias("k0"))
        seen_by = k.select("scene", F.col("frame").alias("other"), F.col("k").alias("k1"))
        pairs = pairs.select("scene", "frame", "other", "m").join(own, ["scene", "frame"]).join(seen_by, ["scene", "other"])
    else:
        same = F.array(*[F.lit(float(x)) for x in (k[0], 0, k[2], 0, k[1], k[3], 0, 0, 1)])
        pairs = pairs.select("scene", "frame", "other", "m", same.alias("k0"), same.alias("k1"))
    held = px.groupBy("scene", "frame").agg(F.collect_list(F.struct("v", "u", F.col("d").cast("double").alias("d"))).alias("own"))
    seen = held.select("scene", F.col("frame").alias("other"), F.col("own").alias("seen"))
    both = pairs.join(held, ["scene", "frame"]).join(seen, ["scene", "other"], "left")
    both = both.select("scene", "frame", "other", *[F.col(c).cast("array<double>").alias(c) for c in ("m", "k0", "k1")], "own", "seen")
    area = height * width

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, flat, there = batch.num_rows, batch.column(6).flatten(), batch.column(7).flatten()
        row, srow = (np.repeat(np.arange(n), pa.compute.list_value_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False)) for c in (6, 7))
        sv, su, sd = (_number(there.field(i)) for i in range(3))
        kept = (sv >= 0) & (sv < height) & (su >= 0) & (su < width) & ~there.field(2).is_null().to_numpy(zero_copy_only=False)
        place = srow[kept] * area + sv[kept].astype(np.int64) * width + su[kept].astype(np.int64)
        grid = np.bincount(place, sd[kept], n * area).reshape(n, height, width)
        (m, good), (k0, good0), (k1, good1) = (_lists(batch.column(i), size) for i, size in ((3, 16), (4, 9), (5, 9)))
        v, u, d = (_number(flat.field(i)) for i in range(3))
        bad = ~(good & good0 & good1)[row]
        for i in range(3):
            bad |= flat.field(i).is_null().to_numpy(zero_copy_only=False)
        m, k0, k1 = m[row].T, k0[row].T, k1[row].T
        with np.errstate(all="ignore"):
            x0, y0 = (u + 0.5 - k0[2]) / k0[0] * d, (v + 0.5 - k0[5]) / k0[4] * d
            x, y, z = (m[4 * i] * x0 + m[4 * i + 1] * y0 + m[4 * i + 2] * d + m[4 * i + 3] for i in range(3))
            to_x, to_y = (k1[0] * x + k1[2] * z) / (z + 1e-4), (k1[4] * y + k1[5] * z) / (z + 1e-4)
            depths = [_depths(to_x, to_y, row, grid, mode) for mode in modes]
        first = np.arange(len(row))
        inside = (v >= 0) & (v < height) & (u >= 0) & (u < width)
        if not inside.all() or (len(row) and np.bincount(row * area + v.astype(np.int64) * width + u.astype(np.int64)).max() > 1):
            # a pixel that occurs twice is one row that counts twice
            v, u = np.nan_to_num(v, nan=-(2.0**62)), np.nan_to_num(u, nan=-(2.0**62))
            order = np.lexsort((bad, u, v, row))
            new = np.ones(len(order), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1])
            first = order[new]
            depths = [np.add.reduceat(np.where(bad, 0.0, x)[order], np.flatnonzero(new)) if len(first) else x for x in depths]
            to_x, to_y, z, bad, row = (x[first] for x in (to_x, to_y, z, bad, row))
        first = pa.array(first)
        columns = [batch.column(i).take(pa.array(row)) for i in range(3)] + [flat.field(i).take(first) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.float64(), mask=bad) for x in (to_x, to_y, z, *depths)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.max([np.full(whole.num_rows, area), *[pa.compute.list_value_length(whole.column(c)).fill_null(0).to_numpy(zero_copy_only=False) for c in (6, 7)]], axis=0)
            until, at = np.cumsum(sizes), 0
            while at < whole.num_rows:
                stop = max(at + 1, int(np.searchsorted(until, until[at] - sizes[at] + PIXELS, side="right")))
                yield of(whole.slice(at, stop - at))
                at = stop

    kinds = both.schema
    pixel = px.select("v", "u").schema
    out = StructType([*[StructField(c, kinds[c].dataType) for c in ("scene", "frame", "other")], *[StructField(c, pixel[c].dataType) for c in "vu"], *[StructField(c, DoubleType()) for c in ("d", "px", "py", "z", *modes)]])
    names = out.names
    return both.mapInArrow(run, out)


def _judged(mode: str, height: int, width: int, threshold: float, soft: float | None) -> tuple[Column, Column]:
    """error and mask of what _moved has found by a mode."""
    bd = F.col(mode)
    error = F.when(bd != 0, F.abs(F.try_divide(bd - F.col("z"), bd))).otherwise(float("inf"))
    inside = (F.col("px") > 0) & (F.col("px") < width - 1) & (F.col("py") > 0) & (F.col("py") < height - 1) & (F.col("d") > 0)
    return error, F.coalesce(inside & (error < threshold), F.lit(False)) if soft is None else F.coalesce(F.when(inside, F.exp(-error / soft)), F.lit(0.0))


def _placed(height: int, width: int) -> list[Column | str]:
    return ["scene", "frame", "other", "v", "u", (2 * F.col("px") / width - 1).alias("wx"), (2 * F.col("py") / height - 1).alias("wy")]


def warp(px: DataFrame, pairs: DataFrame, k: tuple[float, float, float, float] | DataFrame, height: int, width: int, threshold: float = 0.05, soft: float | None = None, mode: str = "bilinear") -> DataFrame:
    """scene, frame, other, v, u, wx, wy (in -1..1), error and mask (or its soft form) of pixels moved into other frames.

    px: scene, frame, v, u, d. pairs: scene, frame, other, m (4x4 from frame to other). k: fx, fy, cx, cy of all frames,
    or a table scene, frame, k (3x3) that joins both sides of a pair; pairs of a frame without one have no rows. A pixel
    counts if its depth is positive, it falls strictly inside the other image and the depth seen there differs by less
    than ``threshold``, or weighs exp(-error / soft). ``mode`` bilinear or nearest; outside the image depths are 0. A
    pixel with a null depth, or of a frame with a null matrix, has null places and does not count; frames without a
    pair have no rows; pixels that occur twice count twice.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    error, mask = _judged(mode, height, width, threshold, soft)
    return _moved(px, pairs, k, height, width, (mode,)).select(*_placed(height, width), error.alias("error"), mask.alias("mask"))


def warp_combined(px: DataFrame, pairs: DataFrame, k: tuple[float, float, float, float] | DataFrame, height: int, width: int, threshold: float = 0.05) -> DataFrame:
    """Bilinear warps, and nearest ones where only those hold; ``linear`` tells where the bilinear one holds. Both are
    made in one pass."""
    (error, mask), (near, held) = (_judged(mode, height, width, threshold, None) for mode in MODES)
    got = _moved(px, pairs, k, height, width, MODES)
    return got.select(*_placed(height, width), F.when(held & ~mask, near).otherwise(error).alias("error"), (mask | held).alias("mask"), mask.alias("linear"))
