"""Queries over the pixel relation that is derived from ``embeddings``, with the same in SQL.

A vector of 64 numbers is an 8 x 8 frame: raw log depths, and confidences from the numbers in reverse. Scenes are
labels, frames follow vec_id, and cameras turn and move with the frame number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators import align, cameras as views, masks, sampling, scoring, stats, warp, whole
from scenelake.streaming import frames as arriving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(c: Column | str, name: str) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 4) + 0.0).alias(name)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("scene"), place.cast("long").alias("frame"), F.col("embedding").alias("e"))


def cameras(fr: DataFrame) -> DataFrame:
    a = F.col("frame") * 0.05
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(F.cos(a), zero, F.sin(a), F.col("frame") * 0.2, zero, one, zero, zero, -F.sin(a), zero, F.cos(a), F.col("frame") * 0.1, zero, zero, zero, one)
    flag = F.when(F.col("scene") == 9, F.col("frame") == 0).otherwise(F.col("frame") % 4 == 0)
    k = F.array(*[F.lit(x) for x in (8.0, 0.0, 3.5, 0.0, 8.0, 3.5, 0.0, 0.0, 1.0)])
    return fr.select("scene", "frame", pose.alias("pose"), k.alias("k"), (F.col("frame") % 3 != 2).alias("has_depth"), flag.alias("has_pose"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, frame, v, u, raw, d (0 where invalid), valid, lx, ly, lz, conf."""
    px = frames(spark, sf_dir).select("scene", "frame", "e", F.posexplode("e").alias("i", "raw"))
    lz = F.exp(F.least(0.1 * F.col("raw").cast("double"), F.lit(15.0)))
    px = px.select("scene", "frame", F.expr("i div 8").alias("v"), (F.col("i") % 8).cast("long").alias("u"), F.col("raw").cast("double").alias("raw"), lz.alias("lz"), geo.sigmoid(10 * F.col("e")[63 - F.col("i")].cast("double")).alias("conf"))
    d = geo.sanitize_depth(F.when(F.col("raw") < -0.4, 0.0).otherwise(F.col("lz")))
    return px.withColumns({"d": d, "lx": (F.col("u") - 3.5) / 8 * F.col("lz"), "ly": (F.col("v") - 3.5) / 8 * F.col("lz")}).withColumn("valid", F.col("d") > 0)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, frame and arrays e, d, lx, ly, lz of whole frames, as pixels() has them."""
    fr = frames(spark, sf_dir).withColumn("e", F.transform("e", lambda x: x.cast("double")))
    fr = fr.withColumn("lz", F.transform("e", lambda x: F.exp(F.least(0.1 * x, F.lit(15.0)))))
    d = F.zip_with("e", "lz", lambda x, z: geo.sanitize_depth(F.when(x < -0.4, 0.0).otherwise(z)))
    return fr.withColumns({"d": d, "lx": F.transform("lz", lambda z, i: (i % 8 - 3.5) / 8 * z), "ly": F.transform("lz", lambda z, i: (F.floor(i / 8) - 3.5) / 8 * z)})


def world(px: DataFrame) -> DataFrame:
    """Global points; the pose follows from the frame number, so it is computed in the row instead of joined."""
    a, f = F.col("frame") * 0.05, F.col("frame")
    return px.withColumns({"x": F.cos(a) * F.col("lx") + F.sin(a) * F.col("lz") + 0.2 * f, "y": F.col("ly"), "z": -F.sin(a) * F.col("lx") + F.cos(a) * F.col("lz") + 0.1 * f})


_PX = """WITH fr AS (SELECT label AS scene, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e FROM embeddings),
px0 AS (SELECT scene, frame, (i // 8)::BIGINT AS v, (i % 8)::BIGINT AS u, e[i + 1]::DOUBLE AS raw,
  exp(least(0.1::DOUBLE * e[i + 1]::DOUBLE, 15.0::DOUBLE)) AS lz, 1 / (1 + exp(-10::DOUBLE * e[64 - i]::DOUBLE)) AS conf FROM fr, range(64) t(i)),
px AS MATERIALIZED (SELECT *, CASE WHEN raw < -0.4 THEN 0::DOUBLE ELSE lz END AS d, NOT raw < -0.4 AS valid,
  (u - 3.5::DOUBLE) / 8 * lz AS lx, (v - 3.5::DOUBLE) / 8 * lz AS ly FROM px0),
cam AS (SELECT scene, frame, cos(frame * 0.05::DOUBLE) AS c, sin(frame * 0.05::DOUBLE) AS s, frame * 0.2::DOUBLE AS tx, frame * 0.1::DOUBLE AS tz,
  frame % 3 <> 2 AS has_depth, CASE WHEN scene = 9 THEN frame = 0 ELSE frame % 4 = 0 END AS has_pose FROM fr),
w AS (SELECT px.*, c * lx + s * lz + tx AS x, ly AS y, -s * lx + c * lz + tz AS z FROM px JOIN cam USING (scene, frame))
"""
_STENCIL = """, sp AS (SELECT a.scene, a.frame, a.v, a.u, max(CASE WHEN b.valid THEN b.d END) - min(CASE WHEN b.valid THEN b.d END) AS spread
  FROM px a JOIN px b ON a.scene = b.scene AND a.frame = b.frame AND abs(a.v - b.v) <= 1 AND abs(a.u - b.u) <= 1 GROUP BY ALL),
de AS (SELECT px.*, CASE WHEN spread IS NULL THEN false WHEN d <> 0 THEN spread / d > 0.03 ELSE spread > 0 END AS depth_edge FROM px JOIN sp USING (scene, frame, v, u))
"""
_NORMALS = """, nb AS (SELECT p.scene, p.frame, p.v, p.u, p.valid, k.k,
  coalesce(q.valid, false) AS ok, CASE WHEN q.valid THEN q.lx ELSE 0 END - CASE WHEN p.valid THEN p.lx ELSE 0 END AS dx,
  CASE WHEN q.valid THEN q.ly ELSE 0 END - CASE WHEN p.valid THEN p.ly ELSE 0 END AS dy, CASE WHEN q.valid THEN q.lz ELSE 0 END - CASE WHEN p.valid THEN p.lz ELSE 0 END AS dz
  FROM px p JOIN (VALUES (0, -1, 0), (1, 0, -1), (2, 1, 0), (3, 0, 1)) k(k, dv, du) ON true
  LEFT JOIN px q ON q.scene = p.scene AND q.frame = p.frame AND q.v = p.v + k.dv AND q.u = p.u + k.du),
cr AS (SELECT a.scene, a.frame, a.v, a.u, a.k, a.ok AND b.ok AND a.valid AS ok, a.dy * b.dz - a.dz * b.dy AS cx, a.dz * b.dx - a.dx * b.dz AS cy, a.dx * b.dy - a.dy * b.dx AS cz
  FROM nb a JOIN nb b ON a.scene = b.scene AND a.frame = b.frame AND a.v = b.v AND a.u = b.u AND b.k = (a.k + 1) % 4),
cu AS (SELECT *, greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-12::DOUBLE) AS n FROM cr),
ns AS (SELECT scene, frame, v, u, bool_or(ok) AS has_normal, sum(CASE WHEN ok THEN cx / n ELSE 0 END) AS sx, sum(CASE WHEN ok THEN cy / n ELSE 0 END) AS sy, sum(CASE WHEN ok THEN cz / n ELSE 0 END) AS sz FROM cu GROUP BY ALL),
nm AS (SELECT scene, frame, v, u, has_normal, sx / l AS nx, sy / l AS ny, sz / l AS nz FROM (SELECT *, greatest(sqrt(sx * sx + sy * sy + sz * sz), 1e-12::DOUBLE) AS l FROM ns))
"""
_EDGES = _STENCIL + _NORMALS + """, an AS (SELECT a.scene, a.frame, a.v, a.u, a.has_normal,
  max(CASE WHEN b.has_normal THEN acos(least(greatest(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz, -1::DOUBLE), 1::DOUBLE)) ELSE 0 END) AS angle
  FROM nm a JOIN nm b ON a.scene = b.scene AND a.frame = b.frame AND abs(a.v - b.v) <= 1 AND abs(a.u - b.u) <= 1 GROUP BY ALL),
ne AS (SELECT a.scene, a.frame, a.v, a.u, max(b.angle) > radians(5::DOUBLE) AND a.has_normal AS normal_edge
  FROM an a JOIN an b ON a.scene = b.scene AND a.frame = b.frame AND abs(a.v - b.v) <= 1 AND abs(a.u - b.u) <= 1 GROUP BY a.scene, a.frame, a.v, a.u, a.has_normal),
ed AS (SELECT de.*, normal_edge, depth_edge AND normal_edge AS edge FROM de JOIN ne USING (scene, frame, v, u))
"""


def _r(x: str, name: str) -> str:
    return f"round({x}, 4) + 0.0 AS {name}"


@_query(_PX + _STENCIL + f"""SELECT scene, frame, count(*) FILTER (conf > 0.1 AND valid AND NOT depth_edge) AS n_points, {_r('quantile_cont(x, 0.05)', 'x_low')}, {_r('quantile_cont(x, 0.95)', 'x_high')},
{_r('quantile_cont(z, 0.05)', 'z_low')}, {_r('quantile_cont(z, 0.95)', 'z_high')} FROM de JOIN w USING (scene, frame, v, u) GROUP BY scene, frame""".replace("conf >", "de.conf >").replace("AND valid", "AND de.valid"))
def usable_points_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable world points of each frame, and the extent of all its points."""
    px = world(masks.depth_edges(masks.by_frame(pixels(spark, sf_dir))))
    usable = masks.above(F.col("conf"), 0.1) & F.col("valid") & ~F.col("depth_edge")
    out = px.groupBy("scene", "frame").agg(F.count_if(usable).alias("n_points"), F.percentile("x", [0.05, 0.95]).alias("px"), F.percentile("z", [0.05, 0.95]).alias("pz"))
    return out.select("scene", "frame", "n_points", r4(F.col("px")[0], "x_low"), r4(F.col("px")[1], "x_high"), r4(F.col("pz")[0], "z_low"), r4(F.col("pz")[1], "z_high"))


def _sampled(offset: int, keep: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return sampling.interval_sample(events.select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 10, offset).select("event_id", "user_id")

    return run, f"""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 10 = {keep}"""


for _name, _offset, _keep in (("sample_interval", 0, 1), ("sample_interval_offset1", 1, 0)):
    QUERIES[_name], SQL[_name] = _sampled(_offset, _keep)

_CHUNKS = _PX + """, t AS (SELECT scene, max(frame) + 1 AS n FROM fr GROUP BY scene),
ch AS (SELECT fr.scene, frame, c AS chunk, frame - 10 * c AS pos FROM fr JOIN t USING (scene), range(1000) g(c)
  WHERE frame >= 10 * c AND frame < 10 * c + 16 AND c <= greatest(0, ceil((n - 16) / 10.0)))
"""


@_query(_CHUNKS + "SELECT scene, frame, chunk, pos FROM ch")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_chunks(frames(spark, sf_dir).drop("e"))


@_query(_CHUNKS + "SELECT scene, frame, chunk, pos FROM ch WHERE chunk = 0 OR pos >= 6")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.drop_overlap(sampling.assign_chunks(frames(spark, sf_dir).drop("e")))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('c * ((u - 3.5) * d / 8) + s * d + tx', 'x')}, {_r('(v - 3.5) * d / 8', 'y')}, {_r('-s * ((u - 3.5) * d / 8) + c * d + tz', 'z')}, d > 0 AND d < 1.02 AS usable FROM px JOIN cam USING (scene, frame)")
def unproject_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths to world points by integer pixel places and the table of cameras, with a far limit."""
    out = views.depth_to_world(pixels(spark, sf_dir), cameras(frames(spark, sf_dir)), z_far=1.02)
    return out.select("scene", "frame", "v", "u", r4("x", "x"), r4("y", "y"), r4("z", "z"), "usable")


@_query(_PX + f"""SELECT scene, frame, {_r('c', 'r00')}, {_r('s', 'r02')}, {_r('cos(0.35::DOUBLE) * tx - sin(0.35::DOUBLE) * tz', 'tx')},
{_r('sin(0.35::DOUBLE) * tx + cos(0.35::DOUBLE) * tz', 'tz')} FROM cam""")
def relative_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses seen from the first frame of their scene, on a trajectory that starts at its eighth camera."""
    later = cameras(frames(spark, sf_dir).withColumn("frame", F.col("frame") + 7))
    m = views.relative_poses(later.withColumn("frame", F.col("frame") - 7))
    return m.select("scene", "frame", r4(F.col("pose")[0], "r00"), r4(F.col("pose")[2], "r02"), r4(F.col("pose")[3], "tx"), r4(F.col("pose")[11], "tz"))


@_query(_PX + f""", ry AS (SELECT scene, frame, v, u, (u + 0.5 - 3.5) / 8 AS a, (v + 0.5 - 3.5) / 8 AS b, c, s, tx, tz FROM px JOIN cam USING (scene, frame)),
rd AS (SELECT *, sqrt(a * a + b * b + 1) AS n FROM ry), dr AS (SELECT *, (c * a + s) / n AS dx, b / n AS dy, (-s * a + c) / n AS dz FROM rd)
SELECT scene, frame, v, u, {_r('dx', 'dx')}, {_r('dy', 'dy')}, {_r('dz', 'dz')}, {_r('-tz * dy', 'mx')}, {_r('tz * dx - tx * dz', 'my')}, {_r('tx * dy', 'mz')} FROM dr""")
def plucker_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit directions through pixel centres and their moments about the world's origin."""
    inverse = cameras(frames(spark, sf_dir)).withColumn("k", geo.inverse3(F.col("k")))
    px = views.with_cameras(pixels(spark, sf_dir).select("scene", "frame", "v", "u"), inverse)
    ray = geo.plucker(F.col("pose"), F.col("k"), F.col("u"), F.col("v"))
    return px.select("scene", "frame", "v", "u", *[r4(x, n) for x, n in zip(ray, ("dx", "dy", "dz", "mx", "my", "mz"), strict=True)])


@_query(_PX + f"SELECT scene, frame, v, u, {_r('conf', 'conf')} FROM px WHERE conf > 0.1")
def conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where(masks.above(F.col("conf"), 0.1)).select("scene", "frame", "v", "u", r4("conf", "conf"))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('conf', 'conf')} FROM px WHERE conf >= 0.25 AND conf > 1e-5 AND frame = 3")
def display_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.select_frame(pixels(spark, sf_dir).where(masks.displayed(F.col("conf"), 25)), "3: frame.png").select("scene", "frame", "v", "u", r4("conf", "conf"))


@_query(_PX + "SELECT scene, frame, has_pose AND sum(has_pose::INT) OVER (PARTITION BY scene) <> 1 AS has_pose FROM cam")
def lone_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.drop_lone_pose(cameras(frames(spark, sf_dir)).select("scene", "frame", "has_pose"))


@_query(_PX + _STENCIL + "SELECT scene, frame, v, u, depth_edge FROM de")
def depth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.depth_edges(masks.by_frame(pixels(spark, sf_dir))).select("scene", "frame", "v", "u", "depth_edge")


@_query(_PX + _NORMALS + f"SELECT scene, frame, v, u, has_normal, {_r('nx', 'nx')}, {_r('ny', 'ny')}, {_r('nz', 'nz')} FROM nm")
def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.normals(masks.by_frame(pixels(spark, sf_dir))).select("scene", "frame", "v", "u", "has_normal", r4("nx", "nx"), r4("ny", "ny"), r4("nz", "nz"))


@_query(_PX + _EDGES + "SELECT scene, frame, v, u, normal_edge FROM ne")
def normal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.normal_edges(masks.normals(masks.by_frame(pixels(spark, sf_dir)))).select("scene", "frame", "v", "u", "normal_edge")


@_query(_PX + _EDGES + """SELECT scene, frame, count(*) FILTER (valid) AS n_valid, count(*) FILTER (depth_edge AND valid) AS n_depth,
count(*) FILTER (normal_edge AND valid) AS n_normal, count(*) FILTER (edge AND valid) AS n_final FROM ed GROUP BY scene, frame""")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole.edge_counts(grids(spark, sf_dir), 8, 8)


QUERIES["edge_counts_by_pixel"], SQL["edge_counts_by_pixel"] = (lambda spark, sf_dir: masks.edge_counts(masks.edges(pixels(spark, sf_dir)))), SQL["edge_counts"]


for _how, _sql in (("mean", "avg(d) FILTER (d > 0)"), ("median", "quantile_disc(d, 0.5) FILTER (d > 0)")):
    QUERIES[f"normalize_depth_{_how}"] = lambda spark, sf_dir, how=_how: stats.normalize_depth(pixels(spark, sf_dir), how).select("scene", "frame", "v", "u", r4("d", "d"), r4("factor", "factor"))
    SQL[f"normalize_depth_{_how}"] = _PX + f", f AS (SELECT scene, coalesce({_sql}, 1) AS factor FROM px GROUP BY scene) SELECT scene, frame, v, u, {_r('d / (factor + 1e-8)', 'd')}, {_r('factor', 'factor')} FROM px JOIN f USING (scene)"


@_query(_PX + f"SELECT scene, {_r('avg(sqrt(tx * tx + tz * tz)) FILTER (frame > 0)', 'scale')} FROM cam GROUP BY scene")
def pose_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cam = cameras(frames(spark, sf_dir)).select("scene", "frame", F.col("pose")[3].alias("tx"), F.col("pose")[7].alias("ty"), F.col("pose")[11].alias("tz"))
    return stats.pose_scale(cam).select("scene", r4("scale", "scale"))


_FIT = _PX + ", s AS (SELECT scene, frame, u::DOUBLE AS u, v::DOUBLE AS v, lx * (1 + 0.1 * conf) / (abs(lz) + 1e-10) AS a, ly * (1 + 0.1 * conf) / (abs(lz) + 1e-10) AS b FROM px) "


def _bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumns({c: F.col(c) * (1 + 0.1 * F.col("conf")) for c in ("lx", "ly")})


@_query(_FIT + f"SELECT scene, frame, {_r('regr_slope(u, a)', 'fx')}, {_r('regr_slope(v, b)', 'fy')}, {_r('regr_intercept(u, a)', 'cx')}, {_r('regr_intercept(v, b)', 'cy')} FROM s GROUP BY scene, frame")
def recover_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recover_intrinsics(_bent(spark, sf_dir), 8, 8).select("scene", "frame", *[r4(c, c) for c in ("fx", "fy", "cx", "cy")])


@_query(_FIT + f"SELECT scene, frame, {_r('sum(a * (u - 3.5)) / sum(a * a)', 'fx')}, {_r('sum(b * (v - 3.5)) / sum(b * b)', 'fy')}, 3.5::DOUBLE AS cx, 3.5::DOUBLE AS cy FROM s GROUP BY scene, frame")
def recover_intrinsics_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recover_intrinsics(_bent(spark, sf_dir), 8, 8, centered=True).select("scene", "frame", *[r4(c, c) for c in ("fx", "fy", "cx", "cy")])


_BOX = ", ".join(_r(f"quantile_cont({c}, {q})", f"{c}_{n}") for c in "xyz" for q, n in ((0.05, "low"), (0.95, "high")))


@_query(_PX + f"SELECT scene, {_BOX}, {_r('sqrt(' + ' + '.join(f'(quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) ** 2' for c in 'xyz') + ')', 'scale')} FROM w GROUP BY scene")
def scene_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = stats.bounding_box(world(pixels(spark, sf_dir)), ["scene"])
    return box.select("scene", *[r4(c, c) for c in box.columns[1:]])


@_query(_PX + f""", b AS (SELECT scene, frame, quantile_cont(d, 0.02) FILTER (valid) AS lo, quantile_cont(d, 0.98) FILTER (valid) AS h0 FROM px GROUP BY scene, frame),
g AS (SELECT *, CASE WHEN h0 <= lo THEN lo + 1e-6 ELSE h0 END AS hi FROM b)
SELECT scene, frame, v, u, CASE WHEN valid THEN {_r('least(greatest((d - lo) / (hi - lo), 0::DOUBLE), 1::DOUBLE)', 'gray').replace(' AS gray', '')} ELSE 0 END AS gray FROM px JOIN g USING (scene, frame)""")
def depth_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stretch_depth(pixels(spark, sf_dir)).select("scene", "frame", "v", "u", r4("gray", "gray"))


@_query(SQL["depth_stretch"].rsplit("SELECT", 1)[0] + """, x AS (SELECT px.*, least(greatest((d - lo) / (hi - lo), 0::DOUBLE), 1::DOUBLE) AS x FROM px JOIN g USING (scene, frame))
SELECT scene, frame, v, u, """ + ", ".join(f"CASE WHEN valid THEN floor(least(greatest(255 * ({ramp}), 0), 255))::INT ELSE 0 END AS {n}" for n, ramp in (("red", "1.5::DOUBLE * x"), ("green", "1.5::DOUBLE * x - 0.35::DOUBLE"), ("blue", "1.2::DOUBLE - 1.2::DOUBLE * x"))) + " FROM x")
def depth_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three colour ramps over the stretched depths, black where there is none."""
    return stats.ramp_colors(stats.stretch_depth(pixels(spark, sf_dir))).select("scene", "frame", "v", "u", "red", "green", "blue")


_CLOUD = """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y, l_discount::DOUBLE AS z FROM lineitem),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p),
h AS (SELECT l_orderkey, l_linenumber, 0.7 * ((x - x0) / (x1 - x0 + 1e-8)) + 0.2 * ((y - y0) / (y1 - y0 + 1e-8)) + 0.1 * ((z - z0) / (z1 - z0 + 1e-8)) AS hue FROM p, b)
"""


def _hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a cloud of points, coloured by their place in its box, which is one row."""
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), F.col("l_discount").cast("double").alias("z"))
    return stats.hue_colors(p, stats.extent(p))


@_query(_CLOUD + f"SELECT l_orderkey, l_linenumber, {_r('hue', 'hue')} FROM h")
def hue_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hues(spark, sf_dir).select("l_orderkey", "l_linenumber", r4("hue", "hue"))


_HSV = """, g AS (SELECT *, (floor(hue * 6)::INT) % 6 AS s, hue * 6 - floor(hue * 6) AS f FROM h),
c AS (SELECT *, 0.8::DOUBLE * (1 - 0.9::DOUBLE) AS p, 0.8::DOUBLE * (1 - 0.9::DOUBLE * f) AS q, 0.8::DOUBLE * (1 - 0.9::DOUBLE * (1 - f)) AS t FROM g)
SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"floor(least(greatest(255 * (CASE s {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(order))} END), 0), 255))::INT AS {name}"
    for name, order in (("red", ("0.8::DOUBLE", "q", "p", "p", "t", "0.8::DOUBLE")), ("green", ("t", "0.8::DOUBLE", "0.8::DOUBLE", "q", "p", "p")), ("blue", ("p", "p", "t", "0.8::DOUBLE", "0.8::DOUBLE", "q")))
) + " FROM c"


@_query(_CLOUD + _HSV)
def colored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the colours of an uncoloured cloud."""
    return _hues(spark, sf_dir).select("l_orderkey", "l_linenumber", "red", "green", "blue")


@_query(_PX + f"SELECT scene, frame, v // 4 AS tv, u // 4 AS tu, {_r('avg(d)', 'mean_d')}, {_r('min(d)', 'min_d')}, {_r('max(d)', 'max_d')}, count(*) FILTER (valid) AS n_valid FROM px GROUP BY ALL")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.tile_stats(pixels(spark, sf_dir), 4).select("scene", "frame", "tv", "tu", r4("mean_d", "mean_d"), r4("min_d", "min_d"), r4("max_d", "max_d"), "n_valid")


@_query(_PX + f"SELECT scene, frame, a AS tv, b AS tu, {_r('d', 'd')} FROM px JOIN (SELECT a, b FROM range(6) x(a), range(6) y(b)) g ON v = (a * 8) // 6 AND u = (b * 8) // 6")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.resample_nearest(pixels(spark, sf_dir), 8, 6).select("scene", "frame", "tv", "tu", r4("d", "d"))


@_query(_PX + _EDGES + """, t AS (SELECT scene, max(frame) + 1 AS n FROM fr GROUP BY scene),
ch AS (SELECT fr.scene, frame, c AS chunk FROM fr JOIN t USING (scene), range(1000) g(c) WHERE frame >= 10 * c AND frame < 10 * c + 16 AND c <= greatest(0, ceil((n - 16) / 10.0))),
cf AS (SELECT scene, frame, chunk, v, u, CASE WHEN edge THEN 0 ELSE conf END AS conf FROM ed JOIN ch USING (scene, frame)),
rk AS (SELECT *, rank() OVER (PARTITION BY scene, chunk, frame ORDER BY conf DESC) AS k, count(*) FILTER (conf > 0.9985) OVER (PARTITION BY scene, chunk) AS n FROM cf)
SELECT scene, chunk, frame, v, u, CASE WHEN n < 10 THEN k <= 6 ELSE conf > 0.9985 END AS accepted FROM rk""")
def topk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pixels after edges lose their confidence; chunks with hardly any take each frame's top tenth instead."""
    px = masks.suppress(whole.with_edges(pixels(spark, sf_dir), 8, 8))
    px = sampling.assign_chunks(px, table=frames(spark, sf_dir)).withColumn("accepted", masks.above(F.col("conf"), 0.9985))
    return masks.top_share(px).select("scene", "chunk", "frame", "v", "u", "accepted")


def _chunk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as each chunk would see them: turned, scaled and moved by the chunk's number."""
    px = sampling.assign_chunks(world(pixels(spark, sf_dir)), table=frames(spark, sf_dir))
    s, k = 1 + 0.1 * F.col("chunk"), F.col("chunk") * 0.3
    px = px.withColumns({"accepted": F.col("conf") > 0.1, **{f"world_{c}": F.col(c) for c in "xyz"}})
    return px.withColumns({"x": s * (F.cos(k) * F.col("x") - F.sin(k) * F.col("y")) + F.col("chunk"), "y": s * (F.sin(k) * F.col("x") + F.cos(k) * F.col("y")), "z": s * F.col("z") - F.col("chunk")})


_PAIRS = _PX + """, t AS (SELECT scene, max(frame) + 1 AS n FROM fr GROUP BY scene),
ch AS (SELECT fr.scene, frame, c AS chunk FROM fr JOIN t USING (scene), range(1000) g(c) WHERE frame >= 10 * c AND frame < 10 * c + 16 AND c <= greatest(0, ceil((n - 16) / 10.0))),
cp AS (SELECT scene, frame, v, u, chunk, (1 + 0.1::DOUBLE * chunk) * (cos(chunk * 0.3::DOUBLE) * x - sin(chunk * 0.3::DOUBLE) * y) + chunk AS x,
  (1 + 0.1::DOUBLE * chunk) * (sin(chunk * 0.3::DOUBLE) * x + cos(chunk * 0.3::DOUBLE) * y) AS y, (1 + 0.1::DOUBLE * chunk) * z - chunk AS z FROM w JOIN ch USING (scene, frame) WHERE conf > 0.1),
pr AS (SELECT a.scene, a.chunk, a.x AS sx, a.y AS sy, a.z AS sz, b.x AS tx, b.y AS ty, b.z AS tz FROM cp a JOIN cp b ON a.scene = b.scene AND a.frame = b.frame AND a.v = b.v AND a.u = b.u AND a.chunk = b.chunk + 1),
mo AS (SELECT scene, chunk, count(*) AS n, sum(sx) / (count(*) + 1e-6) AS mx, sum(tx) / (count(*) + 1e-6) AS mt FROM pr GROUP BY scene, chunk)
"""


@_query(_PAIRS + f"SELECT scene, chunk, n, {_r('mx', 'mean_source_x')}, {_r('mt', 'mean_target_x')}, {_r('sum((sx - mx) * (tx - mt))', 'h00')} FROM pr JOIN mo USING (scene, chunk) GROUP BY scene, chunk, n, mx, mt")
def overlap_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = align.overlap_moments(align.overlap_pairs(_chunk_points(spark, sf_dir)))
    return m.select("scene", "chunk", "n", r4("msx", "mean_source_x"), r4("mtx", "mean_target_x"), r4("h00", "h00"))


def _expected(chunk: Column) -> list[Column]:
    """The planted similarity from a chunk to the one before, as twelve numbers.

    Chunk c holds (1 + 0.1 c) times the points turned by 0.3 c about z, moved by (c, 0, -c).
    """
    s, t = (1 + 0.1 * (chunk - 1)) / (1 + 0.1 * chunk), F.lit(-0.3)
    rows = [[s * F.cos(t), -s * F.sin(t), F.lit(0.0)], [s * F.sin(t), s * F.cos(t), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), s]]
    moved = [chunk * 1.0, F.lit(0.0), chunk * -1.0]
    at = [chunk - 1, F.lit(0.0), 1 - chunk]
    return [x for i in range(3) for x in (*rows[i], at[i] - sum((rows[i][j] * moved[j] for j in (1, 2)), rows[i][0] * moved[0]))]


@_query(_PAIRS + "SELECT scene, chunk, n, 0::BIGINT AS thousandths_off FROM mo")
def sim3_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common pixels of each chunk, and how far its similarity is from the planted one, in whole thousandths."""
    steps = align.sim3(align.overlap_moments(align.overlap_pairs(_chunk_points(spark, sf_dir))))
    planted = [F.abs(F.col("m")[i] - x) for i, x in enumerate(_expected(F.col("chunk")))]
    return steps.select("scene", "chunk", "n", F.floor(F.greatest(*planted) * 1000).cast("long").alias("thousandths_off"))


@_query(_CHUNKS + ", one AS (SELECT scene, frame, chunk FROM ch WHERE chunk = 0 OR pos >= 6) SELECT scene, frame, v, u, chunk, 0::BIGINT AS thousandths_off FROM w JOIN one USING (scene, frame)")
def trajectory_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in frames of their own, aligned by their overlaps, and how far each point is from where it was in the
    world before it was moved with its chunk, in whole thousandths."""
    points = _chunk_points(spark, sf_dir)
    steps = align.sim3(align.overlap_moments(align.overlap_pairs(points)))
    placed = align.compose(steps, sampling.assign_chunks(frames(spark, sf_dir).drop("e")))
    kept = sampling.drop_overlap(points).join(placed, ["scene", "chunk"])
    moved = geo.transform(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    off = F.greatest(*[F.abs(a - F.col(f"world_{c}")) for a, c in zip(moved, "xyz", strict=True)])
    return kept.select("scene", "frame", "v", "u", "chunk", F.floor(off * 1000).cast("long").alias("thousandths_off"))


@_query("""WITH r AS (SELECT label AS scene, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding[1:9]::DOUBLE[] AS e FROM embeddings),
n AS (SELECT scene, frame, [e[i] / sqrt(e[(i - 1) // 3 * 3 + 1] ** 2 + e[(i - 1) // 3 * 3 + 2] ** 2 + e[(i - 1) // 3 * 3 + 3] ** 2) for i in range(1, 10)] AS e FROM r),
d AS (SELECT scene, frame, greatest(abs(e[1] * e[4] + e[2] * e[5] + e[3] * e[6]), abs(e[1] * e[7] + e[2] * e[8] + e[3] * e[9]), abs(e[4] * e[7] + e[5] * e[8] + e[6] * e[9])) AS residual FROM n)
SELECT scene, frame, round(residual, 4) + 0.0 AS residual, residual > 1e-6 AS repaired, 1::DOUBLE AS det, true AS proper FROM d""")
def rotation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far nine numbers are from a rotation, and that the repaired ones are one."""
    r = frames(spark, sf_dir).select("scene", "frame", F.transform(F.slice("e", 1, 9), lambda x: x.cast("double")).alias("r"))
    fixed, m = align.repair_rotations(r), lambda i, j: F.col("rotation")[3 * i + j]
    det = sum((m(0, i) * (m(1, (i + 1) % 3) * m(2, (i + 2) % 3) - m(1, (i + 2) % 3) * m(2, (i + 1) % 3)) for i in range(3)), F.lit(0.0))
    off = F.greatest(*[F.abs(sum((m(i, k) * m(j, k) for k in (1, 2)), m(i, 0) * m(j, 0)) - float(i == j)) for i in range(3) for j in range(i, 3)])
    return fixed.select("scene", "frame", r4("residual", "residual"), "repaired", r4(det, "det"), (off < 1e-9).alias("proper"))


_LONG = "WITH fr AS (SELECT label AS scene, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e FROM embeddings), l AS (SELECT scene, frame, i::INT AS i, e[i + 1]::DOUBLE AS x, e[1]::DOUBLE AS s FROM fr, range(64) t(i)) "


@_query(_PX + f""", tk AS (SELECT scene, frame, t, h, e[16 * t + 8 * h + 1:16 * t + 8 * h + 8]::DOUBLE[] AS q, list_reverse(e[16 * t + 8 * h + 1:16 * t + 8 * h + 8])::DOUBLE[] AS k FROM fr, range(4) a(t), range(2) b(h)),
pairs AS (SELECT a.scene, a.frame, b.frame AS other, a.t, b.t AS s, sum(list_dot_product(a.q, b.k) / sqrt(8::DOUBLE)) AS p FROM tk a JOIN tk b ON a.scene = b.scene AND a.h = b.h GROUP BY ALL),
means AS (SELECT scene, frame, other, avg(p) AS p FROM pairs GROUP BY ALL)
SELECT scene, frame, {_r('sum(p)', 'score')} FROM means GROUP BY scene, frame""")
def frame_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of four tokens with two heads of eight numbers, the keys in reverse; the SQL forms the pairs."""
    part = lambda t, h: F.slice("e", 16 * t + 8 * h + 1, 8)
    tokens = [F.struct(F.concat(part(t, 0), part(t, 1)).alias("q"), F.concat(F.reverse(part(t, 0)), F.reverse(part(t, 1))).alias("k")) for t in range(4)]
    tk = frames(spark, sf_dir).select("scene", "frame", F.inline(F.array(*tokens)))
    return stats.frame_similarity(tk, heads=2).select("scene", "frame", r4("score", "score"))


@_query(_LONG + f", m AS (SELECT scene, max(s) AS m FROM l GROUP BY scene) SELECT scene, i, {_r('sum(exp(s - m) * x) / sum(exp(s - m))', 'value')} FROM l JOIN m USING (scene) GROUP BY scene, i")
def softmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir).withColumn("s", F.col("e")[0].cast("double"))
    return stats.softmax_pool(fr, "scene", "s", "e").select("scene", "i", r4("value", "value"))


@_query(_LONG + f"SELECT scene, i, {_r('avg(x)', 'value')} FROM l GROUP BY scene, i")
def frame_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_vector(frames(spark, sf_dir), "scene", "e").select("scene", "i", r4("value", "value"))


@_query(_PX + f""", g AS (SELECT t, least(greatest((t + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0), 7) AS s FROM range(12) x(t)),
wt AS (SELECT t, i, 1 - abs(s - i) AS w FROM g, range(8) y(i) WHERE abs(s - i) < 1)
SELECT scene, frame, a.t AS tv, b.t AS tu, {_r('sum(a.w * b.w * d)', 'd')} FROM px JOIN wt a ON a.i = v JOIN wt b ON b.i = u GROUP BY ALL""")
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warp.resample_bilinear(pixels(spark, sf_dir), 8, 12).select("scene", "frame", "tv", "tu", r4("d", "d"))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('raw', 'raw')} FROM px")
def tile_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as single tiles of 8 x 8."""
    tiles = frames(spark, sf_dir).select("scene", "frame", F.lit(0).alias("tv"), F.lit(0).alias("tu"), "e")
    return warp.expand_tiles(tiles, 8, "e").select("scene", "frame", F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u"), r4(F.col("value").cast("double"), "raw"))


@_query(_PX + f"SELECT scene, frame, v, u, {_r('CASE WHEN frame % 2 = 0 AND conf > 0.5 THEN d ELSE 0 END', 'd')} FROM px")
def prior_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth priors where an earlier pass over the even frames was sure."""
    px = pixels(spark, sf_dir)
    return warp.mask_priors(px.drop("conf"), px.where("frame % 2 = 0"), 0.5).select("scene", "frame", "v", "u", r4("d", "d"))


_WARP = _PX + """, mv AS (SELECT px.scene, px.frame, v, u, d, a.c * (u + 0.5::DOUBLE - 4) / 8 * d + a.s * d + a.tx - b.tx AS gx, (v + 0.5::DOUBLE - 4) / 8 * d AS y,
  -a.s * (u + 0.5::DOUBLE - 4) / 8 * d + a.c * d + a.tz - b.tz AS gz, b.c AS c, b.s AS s FROM px JOIN cam a USING (scene, frame) JOIN cam b ON b.scene = px.scene AND b.frame = px.frame + 1),
pr AS (SELECT *, (8 * (c * gx - s * gz) + 4 * (s * gx + c * gz)) / (s * gx + c * gz + 1e-4::DOUBLE) AS x2,
  (8 * y + 4 * (s * gx + c * gz)) / (s * gx + c * gz + 1e-4::DOUBLE) AS y2, s * gx + c * gz AS z FROM mv),
nr AS (SELECT pr.scene, pr.frame, pr.v, pr.u, pr.d, x2, y2, z, coalesce(sum((1 - abs(y2 - 0.5::DOUBLE - q.v)) * (1 - abs(x2 - 0.5::DOUBLE - q.u)) * q.d), 0) AS bd FROM pr
  LEFT JOIN px q ON q.scene = pr.scene AND q.frame = pr.frame + 1 AND abs(y2 - 0.5::DOUBLE - q.v) < 1 AND abs(x2 - 0.5::DOUBLE - q.u) < 1 GROUP BY ALL)
"""


@_query(_WARP + f"""SELECT scene, frame, v, u, {_r('2 * x2 / 8 - 1', 'wx')}, {_r('2 * y2 / 8 - 1', 'wy')},
x2 > 0 AND x2 < 7 AND y2 > 0 AND y2 < 7 AND d > 0 AND bd <> 0 AND abs((bd - z) / nullif(bd, 0)) < 0.05::DOUBLE AS seen FROM nr""".replace("AND bd <> 0 AND abs((bd - z) / nullif(bd, 0)) < 0.05::DOUBLE", "AND coalesce(abs((bd - z) / nullif(bd, 0)) < 0.05::DOUBLE, false)"))
def warp_covisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each pixel falls in the next frame of its scene, and whether that frame sees it at about the same depth."""
    cam = cameras(frames(spark, sf_dir)).select("scene", "frame", "pose")
    nxt = cam.select("scene", (F.col("frame") - 1).alias("frame"), F.col("frame").alias("other"), geo.se3_inverse(F.col("pose")).alias("inv"))
    pairs = cam.join(nxt, ["scene", "frame"]).select("scene", "frame", "other", geo.matmul4(F.col("inv"), F.col("pose")).alias("m"))
    out = warp.warp(pixels(spark, sf_dir), pairs, (8.0, 8.0, 4.0, 4.0), 8, 8)
    return out.select("scene", "frame", "v", "u", r4("wx", "wx"), r4("wy", "wy"), F.col("mask").alias("seen"))


@_query(_PX + f"""SELECT scene, frame, a AS tv, b AS tu, {_r('d', 'd')} FROM (SELECT * FROM px WHERE u < 6) px
JOIN (SELECT a, b FROM range(5) x(a), range(13) y(b)) g ON v = (a * 8) // 5 AND u = (b * 6) // 13""")
def resample_nearest_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 x 6 as 5 x 13."""
    out = sampling.resample_nearest(pixels(spark, sf_dir).where("u < 6"), (8, 6), (5, 13))
    return out.select("scene", "frame", "tv", "tu", r4("d", "d"))


def _weights(name: str, source: int, target: int) -> str:
    """Weights of the places of one axis, as SQL."""
    at = f"least(greatest((t + 0.5::DOUBLE) * {source} / {target} - 0.5::DOUBLE, 0), {source - 1})"
    return f"{name} AS (SELECT t, i, 1 - abs({at} - i) AS w FROM range({target}) x(t), range({source}) y(i) WHERE abs({at} - i) < 1)"


for _name, _target in (("resample_bilinear_sides", (6, 12)), ("resample_bilinear_shrunk", (12, 3))):
    QUERIES[_name] = lambda spark, sf_dir, target=_target: warp.resample_bilinear(pixels(spark, sf_dir).where("v < 5"), (5, 8), target).select("scene", "frame", "tv", "tu", r4("d", "d"))
    SQL[_name] = _PX + f""", {_weights('wv', 5, _target[0])}, {_weights('wu', 8, _target[1])}
SELECT scene, frame, wv.t AS tv, wu.t AS tu, {_r('sum(wv.w * wu.w * d)', 'd')} FROM px JOIN wv ON wv.i = v JOIN wu ON wu.i = u GROUP BY ALL"""


def _moved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame and the next of its scene, with the way from one camera to the other."""
    cam = cameras(frames(spark, sf_dir)).select("scene", "frame", "pose")
    nxt = cam.select("scene", (F.col("frame") - 1).alias("frame"), F.col("frame").alias("other"), geo.se3_inverse(F.col("pose")).alias("inv"))
    return cam.join(nxt, ["scene", "frame"]).select("scene", "frame", "other", geo.matmul4(F.col("inv"), F.col("pose")).alias("m"))


def _zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics that change from frame to frame."""
    f = F.col("frame")
    k = [8 + 0.1 * (f % 5), F.lit(0.0), 4 - 0.1 * (f % 3), F.lit(0.0), 8 + 0.2 * (f % 4), 3 + 0.1 * (f % 2), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return frames(spark, sf_dir).select("scene", "frame", F.array(*k).alias("k"))


#: Frames of 6 x 8 under intrinsics that differ by frame; nr has the depth by linear sampling, ns that of the nearest pixel.
_ZOOM = _PX + """, kk AS (SELECT scene, frame, 8 + 0.1::DOUBLE * (frame % 5) AS fx, 8 + 0.2::DOUBLE * (frame % 4) AS fy, 4 - 0.1::DOUBLE * (frame % 3) AS cx, 3 + 0.1::DOUBLE * (frame % 2) AS cy FROM fr),
p6 AS MATERIALIZED (SELECT * FROM px WHERE v < 6),
lo AS (SELECT p6.scene, p6.frame, v, u, d, (u + 0.5::DOUBLE - k.cx) / k.fx * d AS x, (v + 0.5::DOUBLE - k.cy) / k.fy * d AS y FROM p6 JOIN kk k USING (scene, frame)),
mv AS (SELECT lo.*, a.c * x + a.s * d + a.tx - b.tx AS gx, -a.s * x + a.c * d + a.tz - b.tz AS gz, b.c AS c, b.s AS s FROM lo JOIN cam a USING (scene, frame) JOIN cam b ON b.scene = lo.scene AND b.frame = lo.frame + 1),
pr AS (SELECT mv.scene, mv.frame, v, u, d, s * gx + c * gz AS z, (k.fx * (c * gx - s * gz) + k.cx * (s * gx + c * gz)) / (s * gx + c * gz + 1e-4::DOUBLE) AS x2,
  (k.fy * y + k.cy * (s * gx + c * gz)) / (s * gx + c * gz + 1e-4::DOUBLE) AS y2 FROM mv JOIN kk k ON k.scene = mv.scene AND k.frame = mv.frame + 1),
nr AS MATERIALIZED (SELECT pr.scene, pr.frame, pr.v, pr.u, pr.d, x2, y2, z, coalesce(sum((1 - abs(y2 - 0.5::DOUBLE - q.v)) * (1 - abs(x2 - 0.5::DOUBLE - q.u)) * q.d), 0) AS bd FROM pr
  LEFT JOIN p6 q ON q.scene = pr.scene AND q.frame = pr.frame + 1 AND abs(y2 - 0.5::DOUBLE - q.v) < 1 AND abs(x2 - 0.5::DOUBLE - q.u) < 1 GROUP BY ALL),
ns AS MATERIALIZED (SELECT pr.*, coalesce(q.d, 0) AS bd FROM pr LEFT JOIN p6 q ON q.scene = pr.scene AND q.frame = pr.frame + 1 AND q.v = floor(y2) AND q.u = floor(x2)),
"""


def _judged(name: str, source: str) -> str:
    inside = "x2 > 0 AND x2 < 7 AND y2 > 0 AND y2 < 5 AND d > 0"
    return f"{name} AS (SELECT *, {inside} AS inside, abs((bd - z) / nullif(bd, 0)) AS error, {inside} AND coalesce(abs((bd - z) / nullif(bd, 0)) < 0.05::DOUBLE, false) AS seen FROM {source})"


def _warped(spark: SparkSession, sf_dir: str, f, **kwargs) -> DataFrame:
    return f(pixels(spark, sf_dir).where("v < 6"), _moved_pairs(spark, sf_dir), _zooms(spark, sf_dir), 6, 8, **kwargs)


_PLACES = f"{_r('2 * x2 / 8 - 1', 'wx')}, {_r('2 * y2 / 6 - 1', 'wy')}"


@_query(_ZOOM + _judged("j", "nr") + f" SELECT scene, frame, v, u, {_PLACES}, seen FROM j")
def warp_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """warp_covisible on frames of 6 x 8 whose intrinsics differ on either side of a pair."""
    return _warped(spark, sf_dir, warp.warp).select("scene", "frame", "v", "u", r4("wx", "wx"), r4("wy", "wy"), F.col("mask").alias("seen"))


@_query(_ZOOM + _judged("j", "ns") + f" SELECT scene, frame, v, u, {_PLACES}, seen FROM j")
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the nearest pixel."""
    return _warped(spark, sf_dir, warp.warp, mode="nearest").select("scene", "frame", "v", "u", r4("wx", "wx"), r4("wy", "wy"), F.col("mask").alias("seen"))


@_query(_ZOOM + _judged("j", "nr") + f" SELECT scene, frame, v, u, {_r('CASE WHEN inside AND error IS NOT NULL THEN exp(-error / 0.1::DOUBLE) ELSE 0 END', 'weight')} FROM j")
def warp_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as weights."""
    return _warped(spark, sf_dir, warp.warp, soft=0.1).select("scene", "frame", "v", "u", r4("mask", "weight"))


@_query(_ZOOM + _judged("j", "nr") + ", " + _judged("n", "ns") + """ SELECT scene, frame, v, u, j.seen OR n.seen AS seen, j.seen AS linear FROM j JOIN n USING (scene, frame, v, u)""")
def warp_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear sampling, filled by the nearest pixel where only that holds, and where the linear one holds."""
    return _warped(spark, sf_dir, warp.warp_combined).select("scene", "frame", "v", "u", F.col("mask").alias("seen"), "linear")


@_query(_PX + f"""SELECT scene, frame, {_r('c / 8', 'q00')}, {_r('-c * 3.5 / 8 + s', 'q02')}, {_r('tx', 'q03')}, 0::BIGINT AS off FROM cam""")
def inverse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World-from-image matrices, and how far from the identity their products with the projections are."""
    cam = cameras(frames(spark, sf_dir)).withColumn("view", geo.se3_inverse(F.col("pose")))
    cam = cam.withColumns({"p": geo.projection(F.col("k"), F.col("view")), "q": geo.inverse_projection(F.col("k"), F.col("view"))})
    one = F.aggregate(F.transform(geo.matmul4(F.col("q"), F.col("p")), lambda x, i: F.abs(x - F.when(i % 5 == 0, 1.0).otherwise(0.0))), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return cam.select("scene", "frame", *[r4(F.col("q")[i], f"q0{i}") for i in (0, 2, 3)], F.floor(one * 1e9).cast("long").alias("off"))


@_query(_PX + f"SELECT scene, frame, {_r('8 * c + 3.5 * s', 'p00')}, {_r('-8 * s + 3.5 * c', 'p02')}, {_r('-(8 * c + 3.5 * s) * tx - (-8 * s + 3.5 * c) * tz', 'p03')} FROM cam")
def projection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image-from-world matrices of all cameras."""
    k = F.array(*[F.lit(x) for x in (8.0, 0.0, 3.5, 0.0, 8.0, 3.5, 0.0, 0.0, 1.0)])
    p = cameras(frames(spark, sf_dir)).withColumn("p", geo.projection(k, geo.se3_inverse(F.col("pose"))))
    return p.select("scene", "frame", *[r4(F.col("p")[i], f"p0{i}") for i in (0, 2, 3)])


@_query("""SELECT user_id, b * INTERVAL 10 MINUTE + TIMESTAMP '1970-01-01' AS start, count(*) AS n, min(ts) AS first FROM (
  SELECT user_id, ts, unnest([epoch_us(ts) // 600000000, epoch_us(ts) // 600000000 - 1, epoch_us(ts) // 600000000 - 2]) AS b FROM events)
WHERE epoch_us(ts) < b * 600000000 + 1500000000 GROUP BY user_id, b""")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in windows of 25 minutes that start every 10; streams use the same function."""
    out = arriving.hopping_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "25 minutes", "10 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("first").cast("timestamp_ntz").alias("first"))


def _lengths(rows: pd.DataFrame) -> pd.DataFrame:
    e = np.stack(rows["e"]).astype(np.float64)
    return rows[["scene", "frame"]].assign(score=np.sqrt((e * e).sum(axis=1)))


@_query(_PX + f"SELECT scene, frame, {_r('sqrt(sum(raw * raw))', 'score')} FROM px GROUP BY scene, frame")
def batched_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of the user's, here the length of a frame's vector, on 64 frames at a time."""
    out = scoring.score_batches(frames(spark, sf_dir), _lengths, "scene long, frame long, score double")
    return out.select("scene", "frame", r4("score", "score"))


def _first_frames(rows: pd.DataFrame) -> pd.DataFrame:
    e = np.stack(rows["input_e"]).astype(np.float64)
    return rows[["scene", "chunk", "frame"]].assign(score=e[:, 0] - e[:, 0].mean())


@_query(_CHUNKS + f", s AS (SELECT scene, chunk, frame, e[1]::DOUBLE AS x FROM ch JOIN fr USING (scene, frame)) SELECT scene, chunk, frame, {_r('x - avg(x) OVER (PARTITION BY scene, chunk)', 'score')} FROM s")
def chunk_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of the user's that sees all frames of a chunk at once."""
    chunked = sampling.assign_chunks(frames(spark, sf_dir), table=frames(spark, sf_dir)).withColumnRenamed("e", "input_e")
    out = scoring.score_chunks(chunked, _first_frames, "scene long, chunk long, frame long, score double")
    return out.select("scene", "chunk", "frame", r4("score", "score"))
