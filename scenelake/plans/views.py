"""Queries over cameras, priors and sources, with the same in SQL; the relations are those of plans/scene.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators import cameras as views
from scenelake.operators import masks, sampling, stats, trajectory, whole
from scenelake.plans.scene import _CHUNKS, _EDGES, _PX, _r, cameras, frames, pixels, r4
from scenelake.sources.frames import capacity_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@_query(_PX + f"SELECT scene, frame, v, u, {_r('u + 0.5::DOUBLE', 'px')}, {_r('v + 0.5::DOUBLE', 'py')} FROM (SELECT scene, frame FROM fr), range(3) a(v), range(5) b(u)")
def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels of frames of 3 x 5."""
    return sampling.pixel_grid(frames(spark, sf_dir).select("scene", "frame"), 3, 5).select("scene", "frame", "v", "u", r4("px", "px"), r4("py", "py"))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('x', 'x')}, {_r('y', 'y')}, {_r('z', 'z')} FROM w")
def global_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local points joined with the table of poses."""
    out = views.local_to_world(pixels(spark, sf_dir), cameras(frames(spark, sf_dir)))
    return out.select("scene", "frame", "v", "u", r4("x", "x"), r4("y", "y"), r4("z", "z"))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('(u + 0.5::DOUBLE - 3.5) / 8 / (1 + 1e-6::DOUBLE)', 'sx')}, {_r('(v + 0.5::DOUBLE - 3.5) / 8 / (1 + 1e-6::DOUBLE)', 'sy')} FROM px")
def ray_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays through pixel centres by the inverse intrinsics, as slopes."""
    inverse = cameras(frames(spark, sf_dir)).withColumn("k", geo.inverse3(F.col("k")))
    px = views.with_cameras(pixels(spark, sf_dir).select("scene", "frame", "v", "u"), inverse)
    sx, sy = geo.slopes(*geo.pixel_ray(F.col("k"), F.col("u"), F.col("v")))
    return px.select("scene", "frame", "v", "u", r4(sx, "sx"), r4(sy, "sy"))


_SCALES = ", sc AS (SELECT scene, exp(avg(raw)) AS m FROM px WHERE scene <> 3 GROUP BY scene) "


def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw scale for every scene but one."""
    return pixels(spark, sf_dir).where("scene <> 3").groupBy("scene").agg(F.avg("raw").alias("raw"))


@_query(_PX + _SCALES + f"SELECT w.scene, frame, v, u, {_r('x * coalesce(m, 1)', 'x')}, {_r('lz * coalesce(m, 1)', 'lz')} FROM w LEFT JOIN sc USING (scene)")
def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.local_to_world(pixels(spark, sf_dir), cameras(frames(spark, sf_dir)))
    return views.metric_points(px, _scales(spark, sf_dir)).select("scene", "frame", "v", "u", r4("x", "x"), r4("lz", "lz"))


@_query(_PX + _SCALES + f"SELECT cam.scene, frame, {_r('c', 'r00')}, {_r('tx * coalesce(m, 1)', 'tx')}, {_r('tz * coalesce(m, 1)', 'tz')} FROM cam LEFT JOIN sc USING (scene)")
def metric_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metric_poses(cameras(frames(spark, sf_dir)), _scales(spark, sf_dir))
    return m.select("scene", "frame", r4(F.col("pose")[0], "r00"), r4(F.col("pose")[3], "tx"), r4(F.col("pose")[11], "tz"))


_FACTORS = ", f AS (SELECT scene, coalesce(avg(d) FILTER (d > 0), 1) AS factor FROM px GROUP BY scene), "
_POSES = (
    _PX + _FACTORS + """ps AS (SELECT cam.scene, frame, has_depth AND cam.scene < 5 AS has_depth, factor,
  (CASE WHEN cam.scene = 7 THEN 0.0001 ELSE 1 END) * tx / factor AS tx, (CASE WHEN cam.scene = 7 THEN 0.0001 ELSE 1 END) * tz / factor AS tz FROM cam JOIN f USING (scene)),
ag AS (SELECT scene, avg(sqrt(tx * tx + tz * tz)) FILTER (frame > 0) AS mean, NOT bool_or(has_depth) AND max(sqrt(tx * tx + tz * tz)) FILTER (frame > 0) >= 0.02 AS moving FROM ps GROUP BY scene)
"""
)


@_query(_POSES + f"SELECT scene, frame, {_r('CASE WHEN moving THEN tx / (mean + 1e-8) ELSE tx END', 'tx')}, {_r('CASE WHEN moving THEN tz / (mean + 1e-8) ELSE tz END', 'tz')}, {_r('CASE WHEN moving THEN factor * mean ELSE factor END', 'factor')} FROM ps JOIN ag USING (scene)")
def normalize_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes 5 and up have no depths; scene 7 hardly moves."""
    cam = cameras(frames(spark, sf_dir)).withColumn("has_depth", F.col("has_depth") & (F.col("scene") < 5))
    small = F.when(F.col("scene") == 7, 0.0001).otherwise(1.0)
    cam = cam.withColumn("pose", F.transform("pose", lambda x, i: F.when(i.isin(3, 7, 11), x * small).otherwise(x)))
    placed, factors = views.normalize_poses(cam, stats.depth_factor(pixels(spark, sf_dir)))
    return placed.join(factors, "scene").select("scene", "frame", r4(F.col("pose")[3], "tx"), r4(F.col("pose")[11], "tz"), r4("factor", "factor"))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('CASE WHEN has_depth THEN d ELSE 0 END', 'd')}, has_depth AS has_depths FROM px JOIN cam USING (scene, frame)")
def depth_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the depth priors of the two thirds of frames that have them."""
    px = pixels(spark, sf_dir)
    out = views.with_depths(px.select("scene", "frame", "v", "u"), px.where("frame % 3 <> 2"))
    return out.select("scene", "frame", "v", "u", r4("d", "d"), "has_depths")


@_query(_PX + f"SELECT scene, frame, has_pose, frame % 5 <> 1 AS has_ray, {_r('CASE WHEN has_pose AND frame % 5 <> 1 THEN c ELSE 1 END', 'r00')}, {_r('CASE WHEN has_pose AND frame % 5 <> 1 THEN tx ELSE 0 END', 'tx')} FROM cam".replace("has_pose,", "has_pose AND frame % 5 <> 1 AS has_pose,", 1))
def pose_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity for frames without a pose, or without the intrinsics that go with it."""
    cam = cameras(frames(spark, sf_dir))
    cam = cam.withColumns({"pose": F.when(F.col("has_pose"), F.col("pose")), "k": F.when(F.col("frame") % 5 != 1, F.col("k"))})
    return views.with_defaults(cam).select("scene", "frame", "has_pose", "has_ray", r4(F.col("pose")[0], "r00"), r4(F.col("pose")[3], "tx"))


@_query(_PX + "SELECT a.scene, a.frame AS i, b.frame AS j FROM cam a JOIN cam b ON a.scene = b.scene AND b.frame > a.frame AND b.frame <= a.frame + 8 WHERE a.has_pose AND b.has_pose")
def view_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with poses, at most eight apart."""
    return views.view_pairs(cameras(frames(spark, sf_dir)), "has_pose", reach=8)


@_query(_PX + f"SELECT scene, frame, v, u, {_r('2 * (8 * lx + 3.5 * lz) / lz', 'a')}, {_r('2 * (8 * ly + 3.5 * lz) / lz', 'b')} FROM px")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local points under the intrinsics, divided by their depth and brought to the plane at 2."""
    px = views.with_cameras(pixels(spark, sf_dir), cameras(frames(spark, sf_dir)))
    a, b = geo.apply_transform(F.col("k"), [F.col(c) for c in ("lx", "ly", "lz")], 3, norm=2.0, ncol=2)
    return px.select("scene", "frame", "v", "u", r4(a, "a"), r4(b, "b"))


@_query(_PX + f"SELECT scene, frame, {_r('c / 2', 'm00')}, {_r('-s / 2', 'm02')}, {_r('-(c * tx - s * tz) / 2', 'm03')}, {_r('-(s * tx + c * tz) / 2', 'm23')} FROM cam")
def inverse_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverses of poses at twice the scale, which are not rigid."""
    twice = F.transform("pose", lambda x, i: F.when(i.isin(0, 1, 2, 4, 5, 6, 8, 9, 10), x * 2).otherwise(x))
    m = cameras(frames(spark, sf_dir)).withColumn("m", geo.inverse4(twice))
    return m.select("scene", "frame", *[r4(F.col("m")[i], n) for i, n in ((0, "m00"), (2, "m02"), (3, "m03"), (11, "m23"))])


@_query(_PX + f"""SELECT scene, frame, {_r('2 * (8 + frame) / 16', 'fx')}, {_r('3 * 8::DOUBLE / 24', 'fy')}, {_r('2 * 3.5::DOUBLE / 16 - 0.5', 'cx')}, {_r('3 * 3.5::DOUBLE / 24 - 0.5', 'cy')},
{_r('1 / (2 * (8 + frame) / 16.0)', 'ifx')}, {_r('-(2 * 3.5::DOUBLE / 16 - 0.5) / (2 * (8 + frame) / 16.0)', 'icx')}, {_r('-(3 * 3.5::DOUBLE / 24 - 0.5)', 'icy')} FROM cam""".replace("2 * (8 + frame) / 16'", "2 * (8 + frame) / 16.0'"))
def intrinsics_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics of frames that are resized to 16 x 24, in units of their sides, and the inverse of that."""
    k = F.array(*[8.0 + F.col("frame") if i == 0 else F.lit(x) for i, x in enumerate((8.0, 0.0, 3.5, 0.0, 8.0, 3.5, 0.0, 0.0, 1.0))])
    m = frames(spark, sf_dir).withColumn("k", geo.normalize_intrinsics(geo.scale_intrinsics(k, F.lit(2.0), F.lit(3.0)), F.lit(16), F.lit(24)))
    m = m.withColumn("i", geo.invert_intrinsics(F.col("k")))
    return m.select("scene", "frame", *[r4(F.col(a)[i], n) for a, i, n in (("k", 0, "fx"), ("k", 4, "fy"), ("k", 2, "cx"), ("k", 5, "cy"), ("i", 0, "ifx"), ("i", 2, "icx"), ("i", 5, "icy"))])


@_query(_PX + f"SELECT scene, frame, {_r('-s', 'm02')}, {_r('-tz', 'm23')}, {_r('s', 'm20')}, {_r('c', 'm22')} FROM cam")
def opengl_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses with the axes y and z turned round: rows 1 and 2 and columns 1 and 2 change their sign."""
    m = cameras(frames(spark, sf_dir)).withColumn("m", geo.opengl_view(F.col("pose")))
    return m.select("scene", "frame", *[r4(F.col("m")[i], n) for i, n in ((2, "m02"), (11, "m23"), (8, "m20"), (10, "m22"))])


@_query(f"SELECT vec_id, (i - 1)::INT AS i, {_r('x / greatest(l, 1e-12)', 'value')} FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x, sqrt(list_sum([y::DOUBLE * y::DOUBLE for y in embedding])) AS l FROM embeddings)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at length 1, number by number."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("e", geo.normalize_vector(F.col("embedding")))
    return e.select("vec_id", F.posexplode("e").alias("i", "value")).select("vec_id", "i", r4("value", "value"))


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_3', 'NATION_8', 'none')")
def sources_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.named(spark.read.parquet(f"{sf_dir}/nation.parquet"), ["NATION_3", "NATION_8", "none"], "n_name").select("n_nationkey", "n_name")


@_query("""SELECT p_partkey, (CASE WHEN p_size % 5 > 2 THEN p_size % 5 - 2 WHEN p_retailprice >= 1000 THEN floor(p_retailprice / 100) WHEN p_partkey % 3 = 0 THEN 10 ELSE 1 END)::INT AS step FROM part""")
def sampling_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of sources: given, by frame rate, or by the kind of file."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(".MP4"))).otherwise(F.col("p_name"))
    rate = F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice") / 100)
    return p.select("p_partkey", sampling.default_interval(path, F.col("p_size") % 5 - 2, rate).cast("int").alias("step"))


@_query(_CHUNKS + "SELECT scene, frame, chunk, pos FROM ch WHERE pos >= 10")
def trailing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that the next chunk meets again."""
    return sampling.trailing(sampling.assign_chunks(frames(spark, sf_dir).drop("e")))


@_query(_PX + "SELECT scene, frame FROM fr WHERE frame < 5")
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.first_frames(frames(spark, sf_dir).drop("e"), 5)


@_query(_PX + "SELECT scene, frame, v, u FROM px WHERE d > 0 AND conf > 0.5")
def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    ok = masks.valid_points(F.col("d"), F.col("lx"), F.col("ly"), F.col("lz"), F.col("conf") > 0.5)
    return px.where(ok).select("scene", "frame", "v", "u")


@_query(_PX + _EDGES + f"SELECT scene, frame, v, u, {_r('CASE WHEN edge THEN 0 ELSE conf END', 'conf')} FROM ed")
def suppressed_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences, 0 at edges."""
    return masks.suppress(whole.with_edges(pixels(spark, sf_dir), 8, 8)).select("scene", "frame", "v", "u", r4("conf", "conf"))


_BEST = """WITH t AS (SELECT l_returnflag AS model, l_linestatus AS resolution, 4 AS tiles, l_linenumber AS n, l_discount < 0.08 AND l_linenumber < 6 AND l_returnflag <> 'R' AS ok,
  l_extendedprice AS peak_mb, l_quantity AS time_s FROM lineitem),
b AS (SELECT model, resolution, tiles, max(row(n, peak_mb, time_s)) FILTER (ok) AS b FROM t GROUP BY model, resolution, tiles)
"""


@_query(_BEST + f"SELECT model, resolution, b[1]::BIGINT AS max_n, (b[1] * tiles)::BIGINT AS total_tiles, {_r('100 * b[2] / 200000', 'util_pct')}, {_r('(b[2] - 500) / b[1]', 'mb_per_img')}, {_r('b[1] / b[3]', 'img_s')} FROM b")
def capacity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as trials of a capacity probe: the largest number that went well, and its ratios."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ok = (F.col("l_discount") < 0.08) & (F.col("l_linenumber") < 6) & (F.col("l_returnflag") != "R")
    trials = lines.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("resolution"), F.lit(4).alias("tiles_per_image"), F.col("l_linenumber").alias("n"), ok.alias("ok"),
        F.col("l_extendedprice").alias("peak_mb"), F.col("l_quantity").alias("time_s"),
    )
    out = capacity_metrics(trials, 200_000, 500)
    return out.select("model", "resolution", F.col("max_n").cast("long").alias("max_n"), F.col("total_tiles").cast("long").alias("total_tiles"), r4("util_pct", "util_pct"), r4("mb_per_img", "mb_per_img"), r4("img_s", "img_s"))


@_query(_PX + _EDGES + "SELECT scene, frame, v, u FROM ed WHERE conf > 0.1 AND NOT edge")
def points_without_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure pixels that a table of edges does not hold."""
    px = pixels(spark, sf_dir)
    return masks.without(px.where(masks.above(F.col("conf"), 0.1)), masks.edges(px).where("edge")).select("scene", "frame", "v", "u")


@_query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def sources_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources that a table of nations selects."""
    some = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return masks.named(spark.read.parquet(f"{sf_dir}/supplier.parquet"), some, "s_nationkey").select("s_suppkey", "s_name")


_ONE = {"pose": [np.eye(4).ravel().tolist()], "zero": [[0.0]]}


def _following(rows: pd.DataFrame) -> pd.DataFrame:
    """Frames of one pixel: their first number as depth, or what the chunk before handed on for it, plus 1."""
    own = [float(e[0]) for e in rows["input_e"]]
    depth = [e if p is None else p[0] + 1 for e, p in zip(own, rows["prior_depth"], strict=True)]
    n = len(rows)
    return pd.DataFrame({"pose": _ONE["pose"] * n, "lx": _ONE["zero"] * n, "ly": _ONE["zero"] * n, "lz": [[d] for d in depth], "conf": [[float(e > 0)] for e in own]})


@_query(_CHUNKS.replace("ch AS", "ch0 AS") + f""", ch AS (SELECT *, lag(chunk) OVER (PARTITION BY scene, frame ORDER BY chunk) IS NOT NULL AS again FROM ch0)
SELECT scene, chunk, frame, {_r('CASE WHEN NOT again THEN e[1]::DOUBLE WHEN e[1] > 0 THEN e[1]::DOUBLE + 1 ELSE 1 END', 'depth')} FROM ch JOIN fr USING (scene, frame)""")
def ordered_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of the user's whose chunks get the depths that the chunk before found sure, and 0 for the others."""
    chunked = sampling.assign_chunks(frames(spark, sf_dir), table=frames(spark, sf_dir)).withColumnRenamed("e", "input_e")
    out = trajectory.in_order(chunked, _following, trajectory.Options(1, 1, ("depth",)), every=True)
    return out.select("scene", "chunk", "frame", r4(F.col("depth")[0], "depth"))


def _planted(rows: pd.DataFrame) -> pd.DataFrame:
    """Cameras and points as each chunk would see them: turned, scaled and moved by its number. Poses that are handed on
    are taken for the scene's own, rays that are handed on are counted up."""
    chunk = int(rows["chunk"].iloc[0])
    s, c, d = 1 + 0.1 * chunk, np.cos(0.3 * chunk), np.sin(0.3 * chunk)
    seen = np.array([[s * c, -s * d, 0, chunk], [s * d, s * c, 0, 0], [0, 0, s, -chunk], [0, 0, 0, 1]])
    i, out = np.arange(64), []
    for f, e, pose, ray in zip(rows["frame"], rows["input_e"], rows["prior_pose"], rows["prior_ray"], strict=True):
        e, a = np.asarray(e, float), 0.05 * f
        z = np.exp(np.minimum(0.1 * e, 15.0))
        own = np.array([[np.cos(a), 0, np.sin(a), 0.2 * f], [0, 1, 0, 0], [-np.sin(a), 0, np.cos(a), 0.1 * f], [0, 0, 0, 1]]) if pose is None else pose
        out.append(((seen @ own).ravel(), (i % 8 - 3.5) / 8 * z, (i // 8 - 3.5) / 8 * z, z, 1 / (1 + np.exp(-10 * e[::-1])), [float(f)] if ray is None else ray + 1))
    return pd.DataFrame(out, columns=["pose", "lx", "ly", "lz", "conf", "ray"])


_SURE = _PX.replace("CASE WHEN raw < -0.4 THEN 0::DOUBLE ELSE lz END AS d, NOT raw < -0.4 AS valid", "lz AS d, conf > 0.05 AS valid") + _EDGES
_SEEN = _CHUNKS[len(_PX) :].replace("ch AS", "ch0 AS") + ", ch AS (SELECT *, row_number() OVER (PARTITION BY scene, frame ORDER BY chunk) - 1 AS before FROM ch0)"


@_query(_SURE + _SEEN + f""", ac AS (SELECT scene, frame, count(*) FILTER (conf > 0.05 AND NOT edge) AS n_accepted FROM ed GROUP BY scene, frame),
mx AS (SELECT scene, frame, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM w GROUP BY scene, frame)
SELECT scene, chunk, frame, before > 0 AS again, n_accepted, frame + before AS ray, {_r('c', 'r00')}, {_r('tx', 'tx')}, {_r('tz', 'tz')}, {_r('x', 'x')}, {_r('y', 'y')}, {_r('z', 'z')}
FROM ch JOIN cam USING (scene, frame) JOIN ac USING (scene, frame) JOIN mx USING (scene, frame)""")
def ordered_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks scored one after another with poses and rays of the chunk before, all in the scene of the first."""
    chunked = sampling.assign_chunks(frames(spark, sf_dir), table=frames(spark, sf_dir)).withColumnRenamed("e", "input_e")
    out = trajectory.in_order(chunked, _planted, trajectory.Options(8, 8, ("pose", "ray")), every=True)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return out.select(
        "scene", "chunk", "frame", "again", F.size(F.filter("accepted", lambda a: a)).cast("long").alias("n_accepted"), F.col("ray")[0].cast("long").alias("ray"),
        *[r4(F.col("pose")[i], n) for i, n in ((0, "r00"), (3, "tx"), (11, "tz"))], *[r4(mean(F.col(c)), c) for c in "xyz"],
    )
