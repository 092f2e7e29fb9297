"""Geometry as column expressions; matrices are row-major arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def at(m: Column, row: int, col: int, width: int = 4) -> Column:
    return m[row * width + col]


def se3_inverse(m: Column) -> Column:
    """Inverse of a rigid 4x4 transform: transposed rotation, turned and negated translation."""
    rows = []
    for i in range(3):
        rows += [at(m, j, i) for j in range(3)]
        rows.append(-sum((at(m, j, i) * at(m, j, 3) for j in range(1, 3)), at(m, 0, i) * at(m, 0, 3)))
    return F.array(*rows, *[F.lit(float(x)) for x in (0, 0, 0, 1)])


def matmul4(a: Column, b: Column) -> Column:
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(1, 4)), at(a, i, 0) * at(b, 0, j)) for i in range(4) for j in range(4)])


def inverse3(m: Column) -> Column:
    """Inverse of a 3x3 matrix by its adjugate; null if singular."""
    e = lambda i, j: at(m, i % 3, j % 3, 3)
    cof = [[e(i + 1, j + 1) * e(i + 2, j + 2) - e(i + 1, j + 2) * e(i + 2, j + 1) for j in range(3)] for i in range(3)]
    det = e(0, 0) * cof[0][0] + e(0, 1) * cof[0][1] + e(0, 2) * cof[0][2]
    return F.when(det != 0, F.array(*[cof[j][i] / det for i in range(3) for j in range(3)]))


@F.pandas_udf(ArrayType(DoubleType()))
def inverse4(m: pd.Series) -> pd.Series:
    """Inverse of a 4x4 matrix; null if it is null, of another size, not finite or singular."""
    ok = np.array([x is not None and len(x) == 16 for x in m], bool)
    out = np.full(len(m), None, object)
    a = np.array([np.asarray(x, float) for x in m[ok]]).reshape(-1, 4, 4)
    good = np.isfinite(a).all((1, 2)) & (np.linalg.matrix_rank(np.where(np.isfinite(a), a, 0)) == 4)
    out[np.flatnonzero(ok)[good]] = [x.ravel().tolist() for x in np.linalg.inv(a[good])]
    return pd.Series(out)


def apply_transform(m: Column, coordinates: list[Column], size: int, norm: float | None = None, ncol: int | None = None) -> list[Column]:
    """Coordinates under a ``size`` x ``size`` matrix: linear if it is as wide as a point, affine if one wider.

    ``norm`` divides by the last coordinate and multiplies by it; that coordinate must not be 0, or the result is
    null. ``ncol`` keeps the first coordinates.
    """
    d = len(coordinates)
    if size not in (d, d + 1):
        raise ValueError(f"a matrix of {size} rows does not act on {d} coordinates")
    out = [sum((at(m, i, j, size) * c for j, c in enumerate(coordinates[1:], 1)), at(m, i, 0, size) * coordinates[0]) for i in range(d)]
    if size == d + 1:
        out = [x + at(m, i, d, size) for i, x in enumerate(out)]
    if norm:
        out = [F.try_divide(x, out[-1]) * norm for x in out]
    return out[:ncol]


def transform(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A 4x4 transform of points, without the last coordinate."""
    return tuple(at(m, i, 0) * x + at(m, i, 1) * y + at(m, i, 2) * z + at(m, i, 3) for i in range(3))


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return tuple(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3))


def unit(*v: Column) -> tuple[Column, ...]:
    """Unit vectors; the length counts as 1e-12 at least."""
    length = F.greatest(F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0])), F.lit(1e-12))
    return tuple(x / length for x in v)


def sanitize_depth(d: Column) -> Column:
    """Depths that are null, not finite or not positive become 0."""
    return F.when(d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf")), d).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scale_intrinsics(k: Column, sx: Column, sy: Column) -> Column:
    return F.array(*[k[i] * (sx if i in (0, 2) else sy if i in (4, 5) else 1) for i in range(9)])


def normalize_intrinsics(k: Column, width: Column, height: Column) -> Column:
    """Intrinsics in units of the frame's sides, with the principal point counted from the centre."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(k[0] / width, zero, k[2] / width - 0.5, zero, k[4] / height, k[5] / height - 0.5, zero, zero, one)


def lift_intrinsics(k: Column) -> Column:
    """3x3 intrinsics as a 4x4 matrix."""
    zero = F.lit(0.0)
    return F.array(*[x for i in range(3) for x in (k[3 * i], k[3 * i + 1], k[3 * i + 2], zero)], zero, zero, zero, F.lit(1.0))


def invert_intrinsics(k: Column) -> Column:
    """Inverse of intrinsics without skew; null where a focal length is 0."""
    zero, one = F.lit(0.0), F.lit(1.0)
    inverse = F.array(F.try_divide(one, k[0]), zero, F.try_divide(-k[2], k[0]), zero, F.try_divide(one, k[4]), F.try_divide(-k[5], k[4]), zero, zero, one)
    return F.when((k[0] != 0) & (k[4] != 0), inverse)


def unproject(d: Column, u: Column, v: Column, k: Column, focal: Column | None = None) -> tuple[Column, Column, Column]:
    """Camera coordinates of depths at whole-numbered pixel places; ``focal`` replaces both focal lengths, by pixel."""
    fx, fy = (k[0], k[4]) if focal is None else (focal, focal)
    return (u - k[2]) * d / fx, (v - k[5]) * d / fy, d


def pixel_ray(inverse: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Ray through a pixel's centre by the inverse intrinsics (made once a camera by inverse3), not of unit length; its
    last coordinate is 1."""
    return tuple(apply_transform(inverse, [u + 0.5, v + 0.5, F.lit(1.0)], 3))


def slopes(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Rays as slopes against the viewing axis."""
    return x / (z + 1e-6), y / (z + 1e-6)


def plucker(pose: Column, inverse: Column, u: Column, v: Column) -> tuple[Column, ...]:
    """Unit direction of a pixel's ray in the world, and its moment about the world's origin."""
    x, y, z = pixel_ray(inverse, u, v)
    turned = [at(pose, i, 0) * x + at(pose, i, 1) * y + at(pose, i, 2) * z for i in range(3)]
    direction = unit(*turned)
    return *direction, *cross(tuple(at(pose, i, 3) for i in range(3)), direction)


def opengl_pose(m: Column) -> Column:
    """A pose between the camera conventions of y down and z ahead, and of y up and z behind: columns 1 and 2 turn round."""
    return F.array(*[-at(m, i, j) if j in (1, 2) else at(m, i, j) for i in range(4) for j in range(4)])


def opengl_view(m: Column) -> Column:
    """The same with the world's axes turned round as well: the change of axes on both sides."""
    return F.array(*[-at(m, i, j) if (i in (1, 2)) != (j in (1, 2)) else at(m, i, j) for i in range(4) for j in range(4)])


def normalize_vector(v: Column) -> Column:
    """An array of numbers at length 1; a length below 1e-12 counts as that."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))


def finite(*columns: Column) -> Column:
    """Whether all are numbers: not null, not NaN and not infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b where positive a over 0 is infinite and 0 over 0 is 0."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, float("inf")).otherwise(0.0)


def hsv_channel(hue: Column, channel: int, saturation: float = 0.9, value: float = 0.8) -> Column:
    """A channel (0 red, 1 green, 2 blue) of a hue in turns."""
    sector = F.floor(hue * 6)
    f = hue * 6 - sector
    p, q, t = F.lit(value * (1 - saturation)), value * (1 - saturation * f), value * (1 - saturation * (1 - f))
    v = F.lit(value)
    order = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = F.when(sector % 6 == 0, order[0][channel])
    for i in range(1, 6):
        out = out.when(sector % 6 == i, order[i][channel])
    return out


def quantize(x: Column) -> Column:
    """A colour in 0..1 as a byte, clipped and truncated."""
    return F.least(F.greatest(x * 255, F.lit(0.0)), F.lit(255.0)).cast("int")


def projection(k: Column | None, view: Column) -> Column:
    """4x4 image-from-world matrix: the intrinsics, lifted to 4x4, times the view; the view alone without intrinsics."""
    if k is None:
        return view
    return matmul4(lift_intrinsics(k), view)


def inverse_projection(k: Column | None, view: Column) -> Column:
    """4x4 world-from-image matrix, the inverse of projection: closed forms, for rigid views and intrinsics without skew."""
    back = se3_inverse(view)
    return back if k is None else matmul4(back, lift_intrinsics(invert_intrinsics(k)))


def pose_matrix(rotation: Column, t: Column) -> Column:
    """4x4 pose of a rotation (nine numbers) and a translation (three); null where either is null or of another size."""
    rows = [x for i in range(3) for x in (*[F.get(rotation, F.lit(3 * i + j)) for j in range(3)], F.get(t, F.lit(i)))]
    return F.when((F.size(rotation) == 9) & (F.size(t) == 3), F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))


def target_size(width: Column, height: Column, limit: int = 255_000, tile: int = 14) -> tuple[Column, Column]:
    """Sides, multiples of ``tile``, of about the frame's shape with at most ``limit`` pixels.

    Sides are rounded half to even; the side that is too long for the shape then gives way, twice at most.
    """
    scale = F.sqrt(limit / (width * height))
    w, h = width * scale, height * scale
    k, m = F.bround(w / tile).cast("long"), F.bround(h / tile).cast("long")
    for _ in range(2):
        over = k * m * tile * tile > limit
        wide = F.try_divide(k, m) > w / h
        k, m = F.when(over & wide, k - 1).otherwise(k), F.when(over & ~wide, m - 1).otherwise(m)
    return F.greatest(k, F.lit(1)) * tile, F.greatest(m, F.lit(1)) * tile


# Mean and deviation of the three colour channels.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def standardize(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple((c - m) / s for c, m, s in zip((r, g, b), CHANNEL_MEAN, CHANNEL_STD, strict=True))
