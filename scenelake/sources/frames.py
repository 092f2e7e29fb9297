"""Catalogues of frame files, their priors, and reports of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIORS = ("poses", "depths", "intrinsics")


def frame_catalog(spark: SparkSession, path: str) -> DataFrame:
    """scene (the file's folder), frame (from 0 by name), path, length; png, jpg and jpeg in any case. Reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(F.lower("path").rlike(r"\.(png|jpg|jpeg)$"))
    files = files.withColumn("scene", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    frame = F.row_number().over(Window.partitionBy("scene").orderBy("name", "path")) - 1
    return files.select("scene", frame.cast("long").alias("frame"), "path", "length")


def decode_frames(files: DataFrame, decode: Callable[[bytes], tuple[int, int]], store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows with path and content: good with width and height, bad with the decoder's error.

    One unreadable file costs its own row alone; null contents are bad. With ``store``, a path, the outcome is written
    there once and both tables read it; without it, each runs the decoder when it is used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, *decode(content), None))
                except Exception as e:  # noqa: BLE001, any decoder may be given
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    out = files.select("path", "content").mapInPandas(run, "path string, width long, height long, error string")
    if store is not None:
        out.write.mode("overwrite").parquet(store)
        out = files.sparkSession.read.parquet(store)
    return out.where("error IS NULL").drop("error"), out.where("error IS NOT NULL").select("path", "error")


def read_conditions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The prior tables (poses, depths, intrinsics) that stand under ``path``; absent ones are left out."""
    found = {}
    for name in PRIORS:
        try:
            found[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
    return found


def with_conditions(frames: DataFrame, priors: dict[str, DataFrame]) -> DataFrame:
    """Frames with the per-frame priors they have, by source frame number; has_<name> tells which those are.

    Depths are a table of pixels: frames get the flag here, pixels the values by ``with_depths``.
    """
    for name in PRIORS:
        if name == "depths" and name in priors:  # by pixel: the frames that have any
            priors = priors | {name: priors[name].select("scene", "frame").distinct()}
        flag = f"has_{name}"
        if name in priors:
            frames = frames.join(priors[name].withColumn(flag, F.lit(True)), ["scene", "frame"], "left")
            frames = frames.withColumn(flag, F.coalesce(flag, F.lit(False)))
        else:
            frames = frames.withColumn(flag, F.lit(False))
    return frames


def condition_mask(p: float, seed: int = 0) -> Column:
    """Whether a row keeps its prior, with chance p: never at 0, always at 1."""
    return F.lit(False) if p <= 0 else F.lit(True) if p >= 1 else F.rand(seed) <= p


def read_capacity(spark: SparkSession, path: str) -> DataFrame:
    """One row for each model and resolution of capacity reports; figures such as N/A become null."""
    rows = spark.read.option("multiLine", True).json(path).select("model", "gpu_total_mb", "model_vram_mb", F.explode("results").alias("r"))
    number = lambda name, kind: F.col("r").getField(name).cast("string").try_cast(kind)
    return rows.select(
        "model", F.col("r").getField("Resolution").alias("resolution"), number("Patches/img", "long").alias("tiles_per_image"), number("Max N", "long").alias("max_n"),
        number("Total patches", "long").alias("total_tiles"), number("Peak VRAM (MB)", "double").alias("peak_mb"), number("VRAM util %", "double").alias("util_pct"),
        number("MB/img", "double").alias("mb_per_img"), number("Time (s)", "double").alias("time_s"), number("Img/s", "double").alias("img_s"),
    )


def capacity_metrics(trials: DataFrame, total_mb: float, model_mb: float) -> DataFrame:
    """The last trial that succeeded for each model and resolution, with its ratios; null where none did.

    Of several trials of one size the one with the largest peak, then time, counts. Trials: model, resolution, tiles_per_image, n, ok, peak_mb, time_s.
    """
    best = trials.groupBy("model", "resolution", "tiles_per_image").agg(F.max(F.when(F.col("ok"), F.struct("n", "peak_mb", "time_s"))).alias("b"))
    n, peak, time = F.col("b.n"), F.col("b.peak_mb"), F.col("b.time_s")
    return best.select(
        "model", "resolution", n.alias("max_n"), (n * F.col("tiles_per_image")).alias("total_tiles"), (100 * peak / total_mb).alias("util_pct"),
        F.try_divide(peak - model_mb, n).alias("mb_per_img"), F.try_divide(n, time).alias("img_s"),
    )
