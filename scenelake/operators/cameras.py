"""Pixels and their camera tables: unprojection, metric scale, normalised poses, priors and pairs of views.

Camera tables have one row a frame: scene, frame, pose (16 numbers, camera to world, by rows), k (9 numbers). Pixel
tables are joined to them by scene and frame; Spark broadcasts a camera table only where it knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.functions.joins import spread_join
from scenelake.functions.naming import keeps_columns

FRAME = ["scene", "frame"]


def with_cameras(px: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixels with ``pose`` and ``k`` of their frame; pixels of frames without a camera are left out."""
    return px.join(cameras.select(*FRAME, *[c for c in ("pose", "k") if c in cameras.columns]), FRAME)


def local_to_world(points: DataFrame, cameras: DataFrame, local: tuple[str, str, str] = ("lx", "ly", "lz")) -> DataFrame:
    """Adds x, y, z: local points moved by the pose of their frame."""
    moved = geo.transform(F.col("pose"), *[F.col(c) for c in local])
    return with_cameras(points, cameras).withColumns(dict(zip("xyz", moved, strict=True))).drop("pose", "k")


def depth_to_world(px: DataFrame, cameras: DataFrame, z_far: float = 0.0, focal: str | None = None) -> DataFrame:
    """Adds x, y, z and ``usable`` from depths ``d``, whole-numbered places v and u, intrinsics and, if there, poses.

    Usable are positive depths, below ``z_far`` where that is positive. ``focal`` names a column that stands for both
    focal lengths of its pixel. Null depths give null points that are not usable.
    """
    px = with_cameras(px, cameras)
    point = geo.unproject(F.col("d"), F.col("u"), F.col("v"), F.col("k"), None if focal is None else F.col(focal))
    if "pose" in cameras.columns:
        point = geo.transform(F.col("pose"), *point)
    usable = F.col("d") > 0
    if z_far > 0:
        usable = usable & (F.col("d") < z_far)
    return px.withColumns(dict(zip("xyz", point, strict=True))).withColumn("usable", F.coalesce(usable, F.lit(False))).drop("pose", "k")


@keeps_columns
def metric_points(points: DataFrame, scales: DataFrame, columns: tuple[str, ...] = ("x", "y", "z", "lx", "ly", "lz")) -> DataFrame:
    """Points times exp(raw) of their scene; ``scales`` has scene and raw. Scenes without a scale stay as they are."""
    metric = F.coalesce(F.exp("_raw"), F.lit(1.0))
    points = spread_join(points, scales.select("scene", F.col("raw").alias("_raw")), ["scene"], "left")
    return points.withColumns({c: F.col(c) * metric for c in columns if c in points.columns}).drop("_raw")


@keeps_columns
def metric_poses(cameras: DataFrame, scales: DataFrame) -> DataFrame:
    """Poses whose translations are multiplied by exp(raw) of their scene."""
    metric = F.coalesce(F.exp("_raw"), F.lit(1.0))
    joined = cameras.join(scales.select("scene", F.col("raw").alias("_raw")), "scene", "left")
    return joined.withColumn("pose", _moved(F.col("pose"), metric)).drop("_raw")


def _moved(pose: Column, scale: Column) -> Column:
    return F.transform(pose, lambda x, i: F.when(i.isin(3, 7, 11), x * scale).otherwise(x))


@keeps_columns
def relative_poses(cameras: DataFrame) -> DataFrame:
    """Poses as seen from the first frame of their scene, which is one row a scene and joins the others."""
    first = cameras.groupBy("scene").agg(F.min_by("pose", "frame").alias("_first"))
    first = first.select("scene", geo.se3_inverse(F.col("_first")).alias("_inverse"))
    return cameras.join(first, "scene").withColumn("pose", geo.matmul4(F.col("_inverse"), F.col("pose"))).drop("_inverse")


def normalize_poses(cameras: DataFrame, factors: DataFrame, static: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(cameras, factors): relative poses and scene factors made free of scale.

    cameras: scene, frame, pose (relative to the first frame), has_depth. factors: scene, factor of its depths. All
    translations are divided by the factor. In a scene of several frames of which none has a depth, and which is not
    static (some later translation is at least ``static`` long), they are divided by their mean length as well and the
    factor is multiplied by it; its depths, normalised by ``factor``, are to be divided by ``scale`` + 1e-8 too.
    Returned factors: scene, factor, scale (1 where nothing more is done).
    """
    placed = cameras.join(factors, "scene")
    placed = placed.withColumn("pose", _moved(F.col("pose"), 1 / F.col("factor")))
    length = F.when(F.col("frame") > 0, F.sqrt(F.col("pose")[3] ** 2 + F.col("pose")[7] ** 2 + F.col("pose")[11] ** 2))
    scenes = placed.groupBy("scene").agg(
        F.first("factor").alias("factor"), F.bool_or("has_depth").alias("_depth"), F.avg(length).alias("_mean"), F.max(length).alias("_most")
    )
    moving = ~F.coalesce("_depth", F.lit(False)) & (F.coalesce("_most", F.lit(0.0)) >= static)
    scenes = scenes.select("scene", F.when(moving, F.col("_mean")).alias("_scale"), "factor")
    placed = placed.drop("factor").join(scenes.select("scene", "_scale"), "scene")
    placed = placed.withColumn("pose", F.when(F.col("_scale").isNull(), F.col("pose")).otherwise(_moved(F.col("pose"), 1 / (F.col("_scale") + 1e-8)))).drop("_scale")
    scale = F.coalesce("_scale", F.lit(1.0))
    return placed, scenes.select("scene", (F.col("factor") * scale).alias("factor"), scale.alias("scale"))


def with_depths(px: DataFrame, depths: DataFrame) -> DataFrame:
    """Pixels with their depth prior ``d``, 0 where there is none or it is not a positive number, and ``has_depths``,
    whether the frame has any prior at all."""
    known = depths.select(*FRAME).distinct().withColumn("has_depths", F.lit(True))
    px = px.drop("d").join(depths.select(*FRAME, "v", "u", "d"), [*FRAME, "v", "u"], "left").join(known, FRAME, "left")
    return px.withColumns({"d": geo.sanitize_depth(F.col("d")), "has_depths": F.coalesce("has_depths", F.lit(False))})


def with_defaults(frames: DataFrame) -> DataFrame:
    """Frames with the identity where a pose is missing, and flags has_pose and has_ray of what was there.

    A pose counts only along with intrinsics, as rays come with poses.
    """
    eye = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    has = {"has_ray": F.col("k").isNotNull(), "has_pose": F.col("pose").isNotNull() & F.col("k").isNotNull()}
    return frames.withColumns(has).withColumn("pose", F.when(F.col("has_pose"), F.col("pose")).otherwise(eye))


def view_pairs(frames: DataFrame, flag: str, reach: int | None = None) -> DataFrame:
    """(scene, i, j): pairs of different frames i < j of a scene that both carry ``flag``; the pair (j, i) is implied.

    With ``reach`` only frames at most so far apart: each frame then meets ``reach`` others at most, by an equi-join on
    the frame. Without it the result has the square of a scene's flagged frames, which is what it lists.
    """
    own = frames.where(F.col(flag)).select("scene", F.col("frame").alias("i"))
    other = own.select("scene", F.col("i").alias("j"))
    if reach is None:
        return own.join(other, "scene").where("i < j")
    steps = own.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + reach)))
    return steps.join(other, ["scene", "j"]).select("scene", "i", "j")
