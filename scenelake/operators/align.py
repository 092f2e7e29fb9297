"""Similarity transforms between overlapping chunks, their composition along a trajectory, and rotation repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import pose_matrix


def overlap_pairs(points: DataFrame) -> DataFrame:
    """(scene, chunk, sx..sz, tx..tz): accepted pixels of a chunk with the same frame and pixel of the chunk before.

    A pixel's chunks stand side by side after one shuffle by pixel, so no table is joined with itself. Pixels with a
    null flag are not accepted; of rows that repeat a chunk's pixel one is taken.
    """
    own = Window.partitionBy("scene", "frame", "v", "u").orderBy("chunk", *"xyz")
    seen = points.where("accepted").select("scene", "chunk", *[F.col(c).alias(f"s{c}") for c in "xyz"], F.lag(F.struct("chunk", *"xyz")).over(own).alias("before"))
    return seen.where(F.col("before.chunk") == F.col("chunk") - 1).select("scene", "chunk", "sx", "sy", "sz", *[F.col(f"before.{c}").alias(f"t{c}") for c in "xyz"])


def overlap_moments(pairs: DataFrame) -> DataFrame:
    """Counts, means, centred cross sums h00..h22 and the source's variance sum by chunk, in one mergeable aggregate.

    Means are sums over n + 1e-6, and sums are centred at them: the covariances, which Spark merges about running
    means, plus what that shift of the centre adds.
    """
    axes, n = [f"{a}{c}" for a in "st" for c in "xyz"], F.col("n")
    crossed = [F.covar_pop(f"s{a}", f"t{b}").alias(f"h{i}{j}") for i, a in enumerate("xyz") for j, b in enumerate("xyz")]
    found = pairs.groupBy("scene", "chunk").agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in axes], *crossed, *[F.var_pop(f"s{c}").alias(f"v{c}") for c in "xyz"])
    shift = {a: F.col(f"m{a}") * (1e-6 / (n + 1e-6)) for a in axes}
    sums = [(n * (F.col(f"h{i}{j}") + shift[f"s{a}"] * shift[f"t{b}"])).alias(f"h{i}{j}") for i, a in enumerate("xyz") for j, b in enumerate("xyz")]
    square = [n * (F.col(f"v{c}") + shift[f"s{c}"] ** 2) for c in "xyz"]
    means = [(F.col(f"m{a}") - shift[a]).alias(f"m{a}") for a in axes]
    return found.select("scene", "chunk", "n", *means, *sums, (square[0] + square[1] + square[2]).alias("square"))


def _sim3(n: np.ndarray, ms: np.ndarray, mt: np.ndarray, h: np.ndarray, square: np.ndarray, least: int = 10) -> np.ndarray:
    """Similarities (rows, 4, 4) from counts, means (rows, 3), cross sums (rows, 3, 3) and variance sums of the source,
    both about the means.

    The reference adds 1e-6 to counts and variances against divisions by zero. In doubles that would bend each step by
    up to 1e-6 of its size, which adds up along a scene, so it is left out; a source that is one point has scale 0.
    """
    m = np.tile(np.eye(4), (len(n), 1, 1))
    ok = np.flatnonzero(n >= least)
    if len(ok):
        u, s, vt = np.linalg.svd(h[ok])
        v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
        flip = np.ones((len(ok), 3))
        flip[:, 2] = np.sign(np.linalg.det(v @ ut))
        r = (v * flip[:, None, :]) @ ut
        wide = square[ok] > 1e-28 * n[ok] * (ms[ok] ** 2).sum(1)  # more than the rounding of equal points
        scale = np.where(wide, (s * flip).sum(1) / np.where(wide, square[ok], 1.0), 0.0)
        m[ok, :3, :3] = scale[:, None, None] * r
        m[ok, :3, 3] = mt[ok] - (m[ok, :3, :3] @ ms[ok][:, :, None])[:, :, 0]
    return m


def sim3_of(source: np.ndarray, target: np.ndarray, least: int = 10) -> np.ndarray:
    """The same for the common points (3, n) of one chunk and the one before, as a 4x4 matrix."""
    n = source.shape[1]
    ms, mt = source.sum(1) / max(n, 1), target.sum(1) / max(n, 1)
    s, t = source - ms[:, None], target - mt[:, None]
    return _sim3(np.array([n]), ms[None], mt[None], (s @ t.T)[None], np.array([(s**2).sum()]), least)[0]


def sim3(moments: DataFrame) -> DataFrame:
    """(scene, chunk, n, m): the similarity that takes a chunk to the one before; identity below ten common pixels."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            of = lambda names: part[names].to_numpy(float)  # noqa: B023, E731
            n, h = part["n"].to_numpy(float), of([f"h{i}{j}" for i in range(3) for j in range(3)]).reshape(-1, 3, 3)
            # from means over n + 1e-6, and sums about these, to the true means
            ds, dt = (of([f"m{a}{c}" for c in "xyz"]) * (1e-6 / n)[:, None] for a in "st")
            h, square = h - n[:, None, None] * ds[:, :, None] * dt[:, None, :], part["square"].to_numpy(float) - n * (ds**2).sum(1)
            m = _sim3(n, of([f"ms{c}" for c in "xyz"]) + ds, of([f"mt{c}" for c in "xyz"]) + dt, h, square)
            yield pd.DataFrame({"scene": part["scene"], "chunk": part["chunk"], "n": part["n"], "m": list(m.reshape(-1, 16))})

    kind = dict(moments.dtypes)
    return moments.mapInPandas(solve, f"scene {kind['scene']}, chunk {kind['chunk']}, n long, m array<double>")


def compose(steps: DataFrame, chunks: DataFrame, least: int = 10) -> DataFrame:
    """(scene, chunk, m): transforms to the frame of chunk 0; one row a chunk enters, by scene.

    A chunk without enough common pixels stands in the global frame itself, which resets the product.
    """
    kind = dict(chunks.dtypes)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part, m, out = part.sort_values("chunk"), np.eye(4), []
        for n, step in zip(part["n"], part["m"], strict=True):
            m = np.eye(4) if step is None or not n >= least else m @ np.array(step).reshape(4, 4)
            out.append(m.ravel().tolist())
        return pd.DataFrame({"scene": part["scene"], "chunk": part["chunk"], "m": out})

    table = chunks.select("scene", "chunk").distinct().join(steps, ["scene", "chunk"], "left")
    return table.groupBy("scene").applyInPandas(walk, f"scene {kind['scene']}, chunk {kind['chunk']}, m array<double>")


def repair_rotations(cameras: DataFrame, column: str = "r") -> DataFrame:
    """Adds ``rotation`` (nearest proper rotation of the row-normalised 3x3), ``residual`` before and ``repaired``.

    What is null, not nine numbers or not finite has null for both and counts as not repaired. Columns of these names
    in the input are replaced.
    """

    @F.pandas_udf("struct<rotation:array<double>,residual:double,repaired:boolean>")
    def fix(r: pd.Series) -> pd.DataFrame:
        good = [i for i, x in enumerate(r) if x is not None and len(x) == 9 and np.isfinite(np.asarray(x, float)).all()]
        out = pd.DataFrame({"rotation": pd.Series([None] * len(r), dtype=object), "residual": pd.Series([None] * len(r), dtype=object), "repaired": False})
        if good:
            m = np.stack([np.asarray(r.iloc[i], float).reshape(3, 3) for i in good])
            m = m / np.maximum(np.linalg.norm(m, axis=2, keepdims=True), 1e-12)
            residual = np.abs(m @ m.transpose(0, 2, 1) - np.eye(3)).max((1, 2))
            u, _, vt = np.linalg.svd(m)
            u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
            for i, fixed, off in zip(good, u @ vt, residual, strict=True):
                out.at[i, "rotation"], out.at[i, "residual"], out.at[i, "repaired"] = fixed.ravel().tolist(), float(off), bool(off > 1e-6)
        return out

    kept = [c for c in cameras.columns if c not in ("rotation", "residual", "repaired")]
    return cameras.select(*kept, fix(column).alias("rotation_")).select(*kept, "rotation_.*")


def repaired_poses(cameras: DataFrame, rotation: str = "r", translation: str = "t") -> DataFrame:
    """Adds ``pose``, the 4x4 matrix of the repaired rotation and the translation, and what repair_rotations adds.

    Null where the nine numbers cannot be repaired or the translation is not three numbers.
    """
    return repair_rotations(cameras, rotation).withColumn("pose", pose_matrix(F.col("rotation"), F.col(translation)))
