"""Scene statistics: normalisation of depths and poses, intrinsics, boxes, colours, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import hsv_channel, quantize
from scenelake.functions.joins import spread_join
from scenelake.functions.naming import keeps_columns


def exact_quantiles(df: DataFrame, by: list[str], column: str, quantiles: list[float], lower: bool = False, accuracy: int = 10_000, cells: int = 1000) -> DataFrame:
    """(by, quantiles): exact quantiles of each group's values, however large a group is; nulls are left out.

    Ranks are found by narrowing, with counts of distinct values in place of rows, so ties cost one row. Mergeable
    approximate percentiles give a bracket around each quantile, of about 4 / ``accuracy`` of the group; the distinct
    values in it are counted, and cut at their own percentiles into ``cells``, of which the one that holds the rank is
    listed: some 4 / accuracy / cells of the group's values at most. No join brings a group to one task. Values between
    two ranks are interpolated, or with ``lower`` taken from the lower one. NaN counts as the largest value, groups are
    told apart as GROUP BY does, but a group with a null key has no row.
    """
    names = [f"_by{i}" for i in range(len(by))]
    values = df.where(F.col(column).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], (F.col(column).cast("double") + 0.0).alias("_x"))
    slack = 2 / accuracy
    ends = [p for q in quantiles for p in (max(0.0, q - slack), min(1.0, q + slack))]
    rough = values.groupBy(*names).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_e"))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col("_e")[2 * i].alias("low"), F.col("_e")[2 * i + 1].alias("high")) for i, q in enumerate(quantiles)])
    rows = spread_join(values, rough.select(*names, "_n", brackets.alias("_b")), names)
    x, key = F.col("_x"), [*names, "_i"]
    rows = rows.select(*names, "_n", "_x", F.inline("_b")).withColumnRenamed("i", "_i")
    side = F.when(x < F.col("low"), -1).when(x > F.col("high"), 1).otherwise(0)
    # one row for each distinct value of a bracket, one for all below and one for all above
    counted = rows.withColumns({"_side": side, "_v": F.when(side == 0, x)}).groupBy(*key, "_n", "q", "_side", "_v").agg(F.count("*").alias("_c"), F.max("_x").alias("_top"), F.min("_x").alias("_bottom"))
    of = lambda value, which: F.max(F.when(F.col("_side") == which, F.col(value)))
    known = counted.groupBy(*key, "_n", "q").agg(F.coalesce(of("_c", -1), F.lit(0)).alias("_below"), of("_top", -1).alias("_prior"), of("_bottom", 1).alias("_next"))
    inside = counted.where("_side = 0")
    parts = [i / cells for i in range(1, cells)]
    cuts = inside.groupBy(*key).agg(F.percentile_approx("_v", parts, 10 * cells).alias("_cuts"))
    celled = spread_join(inside.select(*key, "_v", "_c"), cuts, key).select(*key, "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_cell"))
    sums = celled.groupBy(*key, "_cell").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_start", before)
    place = F.col("q") * (F.col("_n") - 1)
    ranks = F.array(F.floor(place).cast("long"), F.least(F.floor(place) + 1, F.col("_n") - 1).cast("long"))
    wanted = known.select(*key, "_below", F.posexplode(ranks).alias("_which", "_rank")).withColumn("_rank", F.col("_rank") - F.col("_below")).drop("_below")
    cell = sums.join(wanted, key).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_s")))
    chosen = cell.select(*key, "_cell", "_which", (F.col("_rank") - F.col("_start")).alias("_left"))
    # a cell may be chosen for two ranks
    chosen = chosen.groupBy(*key, "_cell").agg(F.collect_list(F.struct("_which", "_left")).alias("_ranks"))
    listed = spread_join(celled, chosen, [*key, "_cell"]).select(*key, "_v", "_c", F.inline("_ranks"))
    listed = listed.groupBy(*key, "_which", "_left").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_in"))
    # the first value at which more are counted than are left
    start = F.struct(F.col("_left").alias("left"), F.lit(None).cast("double").alias("v"))
    step = lambda a, s: F.when(a["v"].isNotNull(), a).otherwise(F.struct((a["left"] - s["_c"]).alias("left"), F.when(a["left"] < s["_c"], s["_v"]).alias("v")))
    found = listed.select(*key, "_which", F.aggregate("_in", start, step)["v"].alias("_value"))
    both = found.groupBy(*key).agg(*[F.max(F.when(F.col("_which") == w, F.col("_value"))).alias(f"_v{w}") for w in (0, 1)])
    out = known.join(both, key, "left")
    # a rank just outside of its bracket is that of the neighbour
    at = lambda w, rank: F.coalesce(F.col(f"_v{w}"), F.when(rank < F.col("_below"), F.col("_prior")).otherwise(F.col("_next")))
    low, high = at(0, ranks[0]), at(1, ranks[1])
    value = low if lower else low + (place - F.floor(place)) * F.when(place > F.floor(place), high - low).otherwise(0.0)
    pairs = out.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_v"))
    return pairs.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], F.transform("_v", lambda s: s["v"]).alias("quantiles"))


def depth_factor(px: DataFrame, how: str = "mean") -> DataFrame:
    """Mean or lower median of each scene's positive depths; 1 where there are none."""
    d = F.when(F.col("d") > 0, F.col("d"))
    if how == "mean":
        return px.groupBy("scene").agg(F.coalesce(F.avg(d), F.lit(1.0)).alias("factor"))
    found = exact_quantiles(px.select("scene", d.alias("d")), ["scene"], "d", [0.5], lower=True)
    return px.select("scene").distinct().join(found, "scene", "left").select("scene", F.coalesce(F.col("quantiles")[0], F.lit(1.0)).alias("factor"))


def hue_colors(points: DataFrame, box: DataFrame) -> DataFrame:
    """Adds ``hue`` and red, green, blue (bytes) by the place of x, y, z in the cloud's box, which is one row."""
    part = {c: (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low") + 1e-8) for c in "xyz"}
    points = points.join(F.broadcast(box)).withColumn("hue", 0.7 * part["x"] + 0.2 * part["y"] + 0.1 * part["z"])
    colors = {n: quantize(hsv_channel(F.col("hue"), i)) for i, n in enumerate(("red", "green", "blue"))}
    return points.withColumns(colors).drop(*box.columns)


def extent(points: DataFrame) -> DataFrame:
    """One row: x_low, x_high and so on, the least and largest coordinates."""
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])


def normalize_depth(px: DataFrame, how: str = "mean") -> DataFrame:
    """Depths divided by their scene's factor plus 1e-8; the factors are one row a scene and join by it.

    Null and non-positive depths do not enter a factor and are divided all the same; a null scene has no rows. A column
    called factor is replaced.
    """
    return spread_join(px.drop("factor"), depth_factor(px, how), ["scene"]).withColumn("d", F.col("d") / (F.col("factor") + 1e-8))


def pose_scale(cameras: DataFrame, static: float = 0.02) -> DataFrame:
    """(scene, scale): mean length of translations after the first frame; 1 for a scene that hardly moves."""
    length = F.when(F.col("frame") > 0, F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2))
    out = cameras.groupBy("scene").agg(F.avg(length).alias("mean"), F.max(length).alias("most"))
    return out.select("scene", F.when(F.col("most") >= static, F.col("mean")).otherwise(1.0).alias("scale"))


def recover_intrinsics(px: DataFrame, width: int, height: int, centered: bool = False, ndc: bool = False) -> DataFrame:
    """Focal lengths and principal points by least squares of pixels on ray slopes, by frame.

    ``ndc`` gives them for coordinates from -1 to 1 along either side. A frame whose slopes are all equal has nulls.
    """
    if ndc:
        found = recover_intrinsics(px, width, height, centered)
        sides = {"x": width, "y": height}
        return found.withColumns({f"{a}{c}": F.col(f"{a}{c}") * 2 / (n - 1) - (1 if a == "c" else 0) for c, n in sides.items() for a in "fc"})
    z = F.abs("lz") + 1e-10
    px = px.withColumns({"_x": F.col("lx") / z, "_y": F.col("ly") / z, "_u": F.col("u").cast("double"), "_v": F.col("v").cast("double")})
    if centered:
        cx, cy = (width - 1) / 2, (height - 1) / 2
        fit = lambda s, t, c: F.try_divide(F.sum(F.col(s) * (F.col(t) - c)), F.sum(F.col(s) * F.col(s)))
        return px.groupBy("scene", "frame").agg(fit("_x", "_u", cx).alias("fx"), fit("_y", "_v", cy).alias("fy")).withColumns({"cx": F.lit(cx), "cy": F.lit(cy)})
    return px.groupBy("scene", "frame").agg(
        F.regr_slope("_u", "_x").alias("fx"), F.regr_slope("_v", "_y").alias("fy"), F.regr_intercept("_u", "_x").alias("cx"), F.regr_intercept("_v", "_y").alias("cy")
    )


def bounding_box(points: DataFrame, by: list[str], columns: tuple[str, str, str] = ("x", "y", "z"), low: float = 0.05, high: float = 0.95, exact: bool = True) -> DataFrame:
    """Percentiles of each axis and the box's diagonal; ``exact=False`` uses mergeable approximate percentiles.

    Exact ones take two passes and never gather a group. Null coordinates are left out of their axis; a group without
    any number on an axis has no exact box.
    """
    if exact:
        box = None
        for c in columns:
            found = exact_quantiles(points, by, c, [low, high]).withColumnRenamed("quantiles", f"_{c}")
            box = found if box is None else box.join(found, by)
    else:
        box = points.groupBy(*by).agg(*[F.percentile_approx(c, [low, high], 100_000).alias(f"_{c}") for c in columns])
    sides = [(F.col(f"_{c}")[1] - F.col(f"_{c}")[0]) ** 2 for c in columns]
    return box.select(*by, *[F.col(f"_{c}")[i].alias(f"{c}_{n}") for c in columns for i, n in ((0, "low"), (1, "high"))], F.sqrt(sides[0] + sides[1] + sides[2]).alias("scale"))


@keeps_columns
def stretch_depth(px: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``gray``: depths between two percentiles of the frame's valid ones as 0..1, clipped; invalid ones are 0."""
    bounds = px.groupBy("scene", "frame").agg(F.percentile(F.when(F.col("valid"), F.col("d")), [low, high]).alias("_b"))
    px = px.join(bounds, ["scene", "frame"])
    lo = F.col("_b")[0]
    hi = F.when(F.col("_b")[1] <= lo, lo + 1e-6).otherwise(F.col("_b")[1])
    gray = F.least(F.greatest((F.col("d") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return px.withColumn("gray", F.when(F.col("valid"), gray).otherwise(0.0)).drop("_b")


def ramp_colors(px: DataFrame, gray: str = "gray", valid: str = "valid") -> DataFrame:
    """Adds red, green and blue (bytes) by three ramps over stretched depths; invalid pixels are black.

    Null depths count as 0, a null flag as invalid; columns of these names in the input are replaced.
    """
    x = F.coalesce(F.col(gray), F.lit(0.0))
    ramps = {"red": 1.5 * x, "green": 1.5 * x - 0.35, "blue": 1.2 - 1.2 * x}
    return px.withColumns({n: F.when(F.col(valid), quantize(r)).otherwise(0) for n, r in ramps.items()})


def softmax_pool(scored: DataFrame, group: str, score: str, vector: str) -> DataFrame:
    """(group, i, value): vectors averaged by the softmax of their scores, element by element."""
    most = scored.groupBy(group).agg(F.max(score).alias("_most"))
    w = spread_join(scored, most, [group]).withColumn("_w", F.exp(F.col(score) - F.col("_most")))
    long = w.select(group, "_w", F.posexplode(vector).alias("i", "_x"))
    return long.groupBy(group, "i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("value"))


def mean_vector(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, i, value): plain averages of vectors."""
    return vectors.select(group, F.posexplode(vector).alias("i", "_x")).groupBy(group, "i").agg(F.avg(F.col("_x").cast("double")).alias("value"))


def frame_similarity(tokens: DataFrame, q: str = "q", k: str = "k", heads: int = 1) -> DataFrame:
    """(scene, frame, score): how much a frame's tokens attend to those of all frames of its scene.

    ``tokens`` has a row a token with vectors q and k of all heads side by side. The products q k over the square root
    of a head's width are summed over heads, averaged over the tokens of both frames, and summed over the scene's
    frames, the frame itself included. All of that is linear: it is the product of the frame's mean q with the sum of
    its scene's mean k, so no pair of tokens or frames is formed. Frames count alike, however many tokens they have.
    Tokens with null vectors are left out, repeated ones weigh in a frame's mean; a null scene has no rows.
    """

    def means(vector: str, name: str) -> DataFrame:
        long = tokens.where(F.col(vector).isNotNull()).select("scene", "frame", F.posexplode(vector).alias("i", "x"))
        return long.groupBy("scene", "frame", "i").agg(F.avg(F.col("x").cast("double")).alias(name))

    sums = means(k, "k").groupBy("scene", "i").agg(F.sum("k").alias("k"))
    scale = F.sqrt(F.count("*") / heads)
    return spread_join(means(q, "q"), sums, ["scene", "i"]).groupBy("scene", "frame").agg((F.sum(F.col("q") * F.col("k")) / scale).alias("score"))
