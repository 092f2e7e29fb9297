"""Sampling of frame sequences, and their cutting into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from scenelake.functions.joins import spread_join
from scenelake.functions.naming import keeps_columns


@keeps_columns
def interval_sample(df: DataFrame, by: str, order: list[str], step: int, offset: int = 0) -> DataFrame:
    """Every ``step``-th row of each sequence; ``offset`` 0 keeps the first, 1 counts from one (the step-th first).

    Nulls in ``by`` are one sequence; nulls in ``order`` come first; rows that tie in all of it stand in any order.
    """
    if step < 1:
        raise ValueError("step must be positive")
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1 + offset
    return df.withColumn("_place", place).where(F.col("_place") % step == 0).drop("_place")


def default_interval(path: Column, interval: Column | None = None, fps: Column | None = None) -> Column:
    """The sampling interval of a source: the given one if positive, else one frame a second where the rate is known,
    else 10 for videos (.mp4) and 1 for folders."""
    rule = F.when(F.lower(path).endswith(".mp4"), 10).otherwise(1)
    if fps is not None:
        rule = F.when(fps >= 1, F.floor(fps).cast("int")).otherwise(rule)
    return rule if interval is None else F.when(interval > 0, interval).otherwise(rule)


@keeps_columns
def assign_chunks(frames: DataFrame, size: int = 16, overlap: int = 6, table: DataFrame | None = None) -> DataFrame:
    """Adds ``chunk`` and ``pos``: chunks start every size - overlap frames; the last is the first to reach the end.

    A frame is repeated for each of its chunks, which are at most size / (size - overlap), rounded up. The length of a
    scene is its largest frame number plus 1 in ``table`` (a narrow table of frames, so that wide rows are not
    counted), or in the rows themselves; it is one row a scene, and joins them. Rows with a null scene or frame are
    left out; repeated rows are all assigned.
    """
    if not 0 < overlap < size:
        raise ValueError("0 < overlap < size is needed")
    hop = size - overlap
    total = (F.max("frame") + 1).cast("long")
    last = (frames if table is None else table).groupBy("scene").agg(F.greatest(F.lit(0), F.ceil((total - size) / hop)).cast("long").alias("_last"))
    frames = spread_join(frames, last, ["scene"])
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / hop)).cast("long")
    last = F.least(F.floor(F.col("frame") / hop).cast("long"), F.col("_last"))
    frames = frames.withColumn("chunk", F.explode(F.sequence(first, last))).drop("_last")
    return frames.withColumn("pos", F.col("frame") - F.col("chunk") * hop)


def drop_overlap(chunked: DataFrame, overlap: int = 6) -> DataFrame:
    """Each frame once: all of chunk 0, and later chunks less their first ``overlap`` frames. No shuffle."""
    return chunked.where((F.col("chunk") == 0) | (F.col("pos") >= overlap))


def trailing(chunked: DataFrame, size: int = 16, overlap: int = 6) -> DataFrame:
    """The last ``overlap`` frames of each full chunk, which the next one meets again."""
    return chunked.where(F.col("pos") >= size - overlap)


def sides(size: int | tuple[int, int]) -> tuple[int, int]:
    """Height and width; one number means a square."""
    return (size, size) if isinstance(size, int) else size


def resample_nearest(px: DataFrame, source: int | tuple[int, int], target: int | tuple[int, int]) -> DataFrame:
    """Pixels of a frame of another size (height and width, or the side of a square), each from the nearest one.

    A source pixel serves the target places whose floor(place * source / target) it is, along either axis, so rows are
    made by source pixel alone and nothing is joined. Pixels outside of the frame and with null places make none.
    """
    spans = {}
    for c, n, m in zip("vu", sides(source), sides(target), strict=True):
        inside = (F.col(c) >= 0) & (F.col(c) < n)
        low, high = F.ceil(F.col(c) * m / n).cast("long"), (F.ceil((F.col(c) + 1) * m / n) - 1).cast("long")
        px, spans[f"t{c}"] = px.where(inside & (low <= high)), F.sequence(low, high)
    for c, span in spans.items():
        px = px.withColumn(c, F.explode(span))
    return px


def tile_stats(px: DataFrame, side: int) -> DataFrame:
    """Mean, least and largest depth and the number of valid pixels of each side x side tile.

    Null depths are left out of their tile, null flags are not valid. Where frames' sides must be multiples of
    ``side``, ask check_tiles.
    """
    tiled = px.withColumns({"tv": F.expr(f"v div {side}"), "tu": F.expr(f"u div {side}")})
    return tiled.groupBy("scene", "frame", "tv", "tu").agg(F.avg("d").alias("mean_d"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.count_if("valid").alias("n_valid"))


def check_tiles(frames: DataFrame, side: int = 14) -> DataFrame:
    """frames with their height and width; reading it fails, naming the sides, at a frame that tiles do not fill."""
    whole = (F.col("height") % side == 0) & (F.col("width") % side == 0)
    said = F.concat(F.lit("sides "), F.coalesce(F.col("height").cast("string"), F.lit("null")), F.lit(" x "), F.coalesce(F.col("width").cast("string"), F.lit("null")), F.lit(f" are not multiples of {side}"))
    return frames.where(F.when(whole, True).otherwise(F.raise_error(said).cast("boolean")))


def pixel_grid(frames: DataFrame, height: int, width: int) -> DataFrame:
    """A row for each pixel of each frame: v, u and the homogeneous centre (px, py, 1)."""
    rows = frames.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))))
    rows = rows.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    return rows.withColumns({"px": F.col("u") + 0.5, "py": F.col("v") + 0.5, "pw": F.lit(1.0)})


@F.udtf(returnType=StructType([StructField(n, LongType()) for n in ("v", "u")] + [StructField(n, DoubleType()) for n in ("px", "py", "pw")]))
class PixelGrid:
    """pixel_grid(height, width) for SQL: the pixels of a frame by rows. Tables of frames are served faster by
    pixel_grid(), which stays in the JVM."""

    def eval(self, height: int, width: int):
        for v in range(height):
            for u in range(width):
                yield v, u, u + 0.5, v + 0.5, 1.0


@F.udtf(returnType=StructType([StructField(n, LongType()) for n in ("chunk", "pos")]))
class ChunkIds:
    """chunk_ids(frame, frames, size, overlap) for SQL: the chunks that a frame of a scene belongs to. Tables are served
    faster by assign_chunks(), which stays in the JVM."""

    def eval(self, frame: int, frames: int, size: int, overlap: int):
        hop = size - overlap
        last = max(0, -(-(frames - size) // hop))
        for chunk in range(max(0, -(-(frame - size + 1) // hop)), min(frame // hop, last) + 1):
            yield chunk, frame - chunk * hop


def register_functions(spark: SparkSession) -> None:
    """Makes pixel_grid and chunk_ids known to the session's SQL."""
    spark.udtf.register("pixel_grid", PixelGrid)
    spark.udtf.register("chunk_ids", ChunkIds)
