"""Filters and stencils over pixel tables keyed by scene, frame, v and u.

The stencils are pairs of windows over u and then v. Both partitionings contain (scene, frame), so one repartition by
these keys serves all of them: ``by_frame`` first, and no window adds an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import cross, finite, ratio, unit
from scenelake.functions.naming import keeps_columns

FRAME = ("scene", "frame")


#: Tasks for each of Spark's shuffle partitions: rows are several times as wide in the windows as in the shuffle.
SPREAD = 4


def by_frame(px: DataFrame) -> DataFrame:
    parts = SPREAD * int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return px.repartition(parts, *FRAME)


def _along(axis: str, radius: int | None = None):
    other = "v" if axis == "u" else "u"
    w = Window.partitionBy(*FRAME, other).orderBy(axis)
    return w.rangeBetween(-radius, radius) if radius is not None else w


def _pooled(df: DataFrame, radius: int, first: str = "u", **pools) -> DataFrame:
    """Adds each pool's (value, function) over the square around a pixel; two windows serve all of them."""
    rows = {f"_{out}": how(value).over(_along(first, radius)) for out, (value, how) in pools.items()}
    second = _along("v" if first == "u" else "u", radius)
    return df.withColumns(rows).withColumns({out: how(f"_{out}").over(second) for out, (_, how) in pools.items()}).drop(*rows)


def _near(df: DataFrame, axis: str, value: Column, radius: int, **names: int) -> DataFrame:
    """Adds the value of the pixel that stands so many steps along an axis, null where there is none.

    Places are compared, so sparse frames give no neighbour across a hole.
    """
    here = F.struct(F.col(axis).alias("i"), value.alias("p"))
    moved = {n: (F.lead(here, k) if k > 0 else F.lag(here, -k)).over(_along(axis)) for n, k in names.items()}
    return df.withColumns(moved).withColumns({n: F.when(F.col(n)["i"] == F.col(axis) + k, F.col(n)["p"]) for n, k in names.items()})


def above(score: Column, threshold: float) -> Column:
    """Strictly above, with NaN below everything."""
    return ~F.isnan(score) & (score > threshold)


def displayed(conf: Column, percent: float | None = 10) -> Column:
    """The viewer's filter: at or above a percentage, and above 1e-5."""
    return ~F.isnan(conf) & (conf >= (10 if percent is None else percent) / 100) & (conf > 1e-5)


@keeps_columns
def depth_edges(px: DataFrame, rtol: float = 0.03, atol: float | None = None, kernel: int = 3, depth: str = "d", valid: str = "valid") -> DataFrame:
    """Adds ``depth_edge``: the spread of valid depths around a pixel is large, absolutely or against its own depth.

    A null flag is not valid; a null depth is left out of the spread around it and counts as 0 for itself, so that any
    spread is an edge. Rows with a null v or u are a line of their own; repeated rows are all seen. A column of that
    name is replaced.
    """
    d, r = F.when(F.col(valid), F.col(depth)), kernel // 2
    px = _pooled(px, r, _most=(d, F.max), _least=(d, F.min))
    spread = F.coalesce(F.col("_most") - F.col("_least"), F.lit(float("-inf")))
    edge = ratio(spread, F.col(depth)) > rtol
    return px.withColumn("depth_edge", edge | (spread > atol) if atol is not None else edge).drop("_most", "_least")


@keeps_columns
def normals(px: DataFrame, point: tuple[str, str, str] = ("lx", "ly", "lz"), valid: str = "valid") -> DataFrame:
    """Adds ``nx, ny, nz`` and ``has_normal`` from the four cross products of differences to neighbours.

    A null flag is not valid; null coordinates of a valid pixel make the normals around it null. Of rows that repeat a
    pixel one is each other's neighbour, which is none. Columns of these names are replaced.
    """
    sure = F.coalesce(F.col(valid), F.lit(False))
    here = F.struct(sure.alias("ok"), *[F.when(sure, F.col(c)).otherwise(0.0).alias(c) for c in point])
    px = px.withColumn("_p", here)
    px = _near(_near(px, "v", F.col("_p"), 1, _up=-1, _down=1), "u", F.col("_p"), 1, _left=-1, _right=1)
    delta = {n: tuple(F.coalesce(F.col(n)[c], F.lit(0.0)) - F.col("_p")[c] for c in point) for n in ("_up", "_left", "_down", "_right")}
    ok = {n: F.coalesce(F.col(n)["ok"], F.lit(False)) for n in delta}
    parts, oks = [], []
    for a, b in (("_up", "_left"), ("_left", "_down"), ("_down", "_right"), ("_right", "_up")):
        oks.append(ok[a] & ok[b] & sure)
        parts.append([F.when(oks[-1], x).otherwise(0.0) for x in unit(*cross(delta[a], delta[b]))])
    px = px.withColumns({f"_n{i}": parts[0][i] + parts[1][i] + parts[2][i] + parts[3][i] for i in range(3)})
    px = px.withColumn("has_normal", oks[0] | oks[1] | oks[2] | oks[3])
    px = px.withColumns(dict(zip(("nx", "ny", "nz"), unit(F.col("_n0"), F.col("_n1"), F.col("_n2")), strict=True)))
    return px.drop("_p", *delta, "_n0", "_n1", "_n2")


@keeps_columns
def normal_edges(px: DataFrame, degrees: float = 5.0, kernel: int = 3) -> DataFrame:
    """Adds ``normal_edge``: the largest angle to a valid neighbour's normal, spread to the neighbours, is large.

    A pixel without a normal has a zero vector and so stands at a right angle to all, which spreads as well.
    """
    r = kernel // 2
    steps = [k for k in range(-r, r + 1) if k]
    normal = ("nx", "ny", "nz")
    px = px.withColumn("_n", F.struct(F.col("has_normal").alias("ok"), *normal))
    px = _near(px, "u", F.col("_n"), r, **{f"_u{i}": k for i, k in enumerate(steps)})
    row = F.struct(F.col("_n").alias("c"), *[F.col(f"_u{i}").alias(f"c{i}") for i in range(len(steps))])
    px = px.withColumn("_row", row).drop("_n", *[f"_u{i}" for i in range(len(steps))])
    px = _near(px, "v", F.col("_row"), r, **{f"_v{i}": k for i, k in enumerate(steps)})
    around = [F.col(x)[c] for x in ("_row", *[f"_v{i}" for i in range(len(steps))]) for c in ("c", *[f"c{i}" for i in range(len(steps))])]
    # the angle grows as the dot product falls, so one arc cosine of the least product is enough; least() skips nulls
    dots = [F.when(n["ok"], F.col("nx") * n["nx"] + F.col("ny") * n["ny"] + F.col("nz") * n["nz"]) for n in around]
    angle = F.acos(F.least(F.greatest(F.least(*dots, F.lit(1.0)), F.lit(-1.0)), F.lit(1.0)))
    px = px.withColumn("_angle", angle).drop("_row", *[f"_v{i}" for i in range(len(steps))])
    px = _pooled(px, r, "v", _most=(F.col("_angle"), F.max))
    return px.withColumn("normal_edge", (F.col("_most") > F.radians(F.lit(degrees))) & F.col("has_normal")).drop("_angle", "_most")


def edges(px: DataFrame, rtol: float = 0.03, degrees: float = 5.0, kernel: int = 3) -> DataFrame:
    """Adds ``edge``: depth and normal edge at once; one exchange for all stencils."""
    px = normal_edges(normals(depth_edges(by_frame(px), rtol, kernel=kernel)), degrees, kernel)
    return px.withColumn("edge", F.col("depth_edge") & F.col("normal_edge"))


def edge_counts(px: DataFrame) -> DataFrame:
    """Valid pixels and edges of each kind by frame."""
    counts = {"n_valid": "valid", "n_depth": "depth_edge", "n_normal": "normal_edge", "n_final": "edge"}
    return px.groupBy(*FRAME).agg(*[F.count_if(F.col(c) & F.col("valid")).alias(n) for n, c in counts.items()])


def suppress(px: DataFrame) -> DataFrame:
    """Confidence 0 at edges; rows stay."""
    return px.withColumn("conf", F.when(F.col("edge"), 0.0).otherwise(F.col("conf")))


@keeps_columns
def top_share(px: DataFrame, share: float = 0.1, least: int = 10, chunk: tuple[str, ...] = ("scene", "chunk")) -> DataFrame:
    """``accepted`` stays, but in a chunk of fewer than ``least`` accepted pixels each frame takes its top share.

    Pixels count by chunk, ranks by frame of the chunk. Ties at the last place stay; a frame of too few pixels for a
    first place takes none. The counts are a grouped sum, of one row a chunk, that joins back.
    """
    few = px.groupBy(*chunk).agg((F.count_if("accepted") < least).alias("_few"))
    frame = Window.partitionBy(*chunk, "frame")
    first = F.rank().over(frame.orderBy(F.desc("conf"))) <= F.floor(F.count("*").over(frame) * share)
    px = px.join(few, list(chunk)).withColumn("_first", first)
    return px.withColumn("accepted", F.when(F.col("_few"), F.col("_first")).otherwise(F.col("accepted"))).drop("_few", "_first")


def without(px: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pixels that are not in a table of rejected ones (scene, frame, v, u), such as edges that were stored.

    Rejected pixels may repeat; a pixel with a null key is in no table and stays.
    """
    return px.join(rejected.select("scene", "frame", "v", "u"), ["scene", "frame", "v", "u"], "left_anti")


def drop_lone_pose(frames: DataFrame) -> DataFrame:
    """Clears has_pose in scenes where exactly one frame carries a pose."""
    n = F.sum(F.col("has_pose").cast("int")).over(Window.partitionBy("scene"))
    return frames.withColumn("has_pose", F.col("has_pose") & (n != 1))


def valid_points(depth: Column, x: Column, y: Column, z: Column, mask: Column) -> Column:
    """Finite coordinates and a finite positive depth inside the mask."""
    return finite(depth, x, y, z) & (depth > 0) & F.coalesce(mask, F.lit(False))


def frame_of_label(label: str | None) -> int | None:
    """The frame that a label such as "3: name.png" means; None, no filter, for "All" and what has no number."""
    head = (label or "").split(":")[0].strip()
    return int(head) if head.lstrip("+-").isdigit() else None


def select_frame(df: DataFrame, label: str | None) -> DataFrame:
    """The rows of one frame, or all; tables that are partitioned by frame read that partition alone."""
    frame = frame_of_label(label)
    return df if frame is None else df.where(F.col("frame") == frame)


def first_frames(df: DataFrame, most: int) -> DataFrame:
    """Rows of the first ``most`` frames of each scene."""
    return df.where(F.col("frame") < most)


def named(df: DataFrame, names: list[str] | DataFrame | None, column: str = "name") -> DataFrame:
    """Rows whose name is in a list, or in the column of a table (a semi join); all without names."""
    if isinstance(names, DataFrame):
        return df.join(names.select(column), column, "left_semi")
    return df.where(F.col(column).isin(list(names))) if names else df
