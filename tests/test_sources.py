"""Catalogues, stored scenes, reports, the point cloud sink and frame arithmetic on hand-made inputs."""

import glob
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators import warp
from scenelake.sources import frames, store


def test_catalog_and_decoder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("b.PNG", "a.jpg", "c.jpeg", "notes.txt"):
        (tmp_path / "a" / name).write_bytes(name.encode())
    got = frames.frame_catalog(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r["scene"], r["frame"], r["path"].rsplit("/", 1)[1]) for r in got] == [("a", 0, "a.jpg"), ("a", 1, "b.PNG"), ("a", 2, "c.jpeg")]

    def decode(content: bytes) -> tuple[int, int]:
        if content.startswith(b"b"):
            raise ValueError("not a picture")
        return 4, 3

    good, bad = frames.decode_frames(spark.read.format("binaryFile").load(str(tmp_path / "a")), decode)
    again, _ = frames.decode_frames(spark.read.format("binaryFile").load(str(tmp_path / "a")), decode, store=str(tmp_path / "decoded"))
    assert again.count() == 3 and good.count() == 3 and [tuple(r)[1] for r in bad.collect()] == ["ValueError: not a picture"]


def test_conditions(spark, tmp_path):
    spark.createDataFrame([(0, 1, [1.0])], "scene long, frame long, pose array<double>").write.parquet(str(tmp_path / "poses"))
    priors = frames.read_conditions(spark, str(tmp_path))
    assert set(priors) == {"poses"}
    got = frames.with_conditions(spark.range(2).selectExpr("0L AS scene", "id AS frame"), priors).orderBy("frame").collect()
    assert [(r["has_poses"], r["has_intrinsics"], r["pose"]) for r in got] == [(False, False, None), (True, False, [1.0])]
    rows = spark.range(50)
    assert rows.where(frames.condition_mask(0)).count() == 0 and rows.where(frames.condition_mask(1)).count() == 50


def test_capacity(spark, tmp_path):
    row = {"Resolution": "8x8", "Patches/img": 4, "Max N": 2, "Total patches": 8, "Peak VRAM (MB)": "12", "VRAM util %": "< 1", "MB/img": "N/A", "Time (s)": "2.5", "Img/s": "0.8"}
    (tmp_path / "r.json").write_text(json.dumps({"model": "m", "gpu_total_mb": 100, "model_vram_mb": 2, "results": [row]}, indent=1))
    got = frames.read_capacity(spark, str(tmp_path / "r.json")).first()
    assert (got["max_n"], got["peak_mb"], got["util_pct"], got["mb_per_img"], got["img_s"]) == (2, 12.0, None, None, 0.8)
    trials = spark.createDataFrame([("m", "8x8", 4, n, n < 4, 10.0 * n, 1.0 * n) for n in (1, 2, 4)] + [("m", "9x9", 4, 1, False, 1.0, 1.0)], "model string, resolution string, tiles_per_image long, n long, ok boolean, peak_mb double, time_s double")
    best = {r["resolution"]: r for r in frames.capacity_metrics(trials, 100, 4).collect()}
    assert (best["8x8"]["max_n"], best["8x8"]["total_tiles"], best["8x8"]["util_pct"], best["8x8"]["mb_per_img"]) == (2, 8, 20.0, 8.0)
    assert best["9x9"]["max_n"] is None


def test_scene_store(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "scene long, x double, y double")
    store.write_scene(df, str(tmp_path / "s"))
    assert store.read_scene(spark, str(tmp_path / "s"), "x").columns == ["x"]
    made = []
    for conf in (5, 5, 6):
        out = store.materialize(spark, str(tmp_path / "m"), lambda c=conf: made.append(c) or df, conf=conf, frame="all")
        assert out.count() == 2
    assert made == [5, 6]
    store.write_summary(spark.createDataFrame([("a", None), ("b", "broken")], "name string, error string"), str(tmp_path / "sum"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "sum")).select("name", "status").collect()} == {("a", "OK"), ("b", "FAILED")}


@pytest.mark.parametrize("top", [1.0, 255.0])
def test_ply(spark, tmp_path, top):
    df = spark.range(100).selectExpr("id * 1.0D AS x", "id * 2.0D AS y", "0.5D AS z", f"id / 99 * {top} AS r", "0.0D AS g", f"{top}D AS b")
    df = df.unionByName(spark.sql("SELECT cast(null as double) AS x, 0D AS y, 0D AS z, 0D AS r, 0D AS g, 0D AS b")).repartition(3)
    store.write_ply(df, f"file://{tmp_path}/cloud")
    files = glob.glob(f"{tmp_path}/cloud/*.ply")
    parts = []
    for f in files:
        head, body = open(f, "rb").read().split(b"end_header\n", 1)
        part = np.frombuffer(body, store._VERTEX)
        assert f"element vertex {len(part)}\n".encode() in head
        parts.append(part)
    got = np.sort(np.concatenate(parts), order="x")
    assert len(got) == 100 and not [f for f in files if "/_" in f] and (got["nx"] == 0).all() and (got["blue"] == 255).all()
    assert (got["red"] == (np.arange(100) / 99 * top * (255 / top)).astype(int)).mean() > 0.97


def test_target_size(spark):
    rows = [(w, h) for w in (1, 13, 640, 1000, 1920, 4032, 9000) for h in (1, 20, 480, 1000, 1080, 3024)]

    def looped(w: int, h: int) -> tuple[int, int]:
        s = math.sqrt(255_000 / (w * h))
        k, m = round(w * s / 14), round(h * s / 14)
        while k * m * 196 > 255_000:
            k, m = (k - 1, m) if k / m > w / h else (k, m - 1)
        return max(1, k) * 14, max(1, m) * 14

    df = spark.createDataFrame(rows, "w long, h long")
    for r in df.select("w", "h", *[c.alias(n) for c, n in zip(geo.target_size(F.col("w"), F.col("h")), "ab", strict=True)]).collect():
        assert (r["a"], r["b"]) == looped(r["w"], r["h"])


def test_warp_to_itself(spark):
    px = spark.range(64).selectExpr("0L AS scene", "0L AS frame", "id div 8 AS v", "id % 8 AS u", "1.0D + id % 3 AS d")
    eye = [float(x) for x in np.eye(4).ravel()]
    pairs = spark.createDataFrame([(0, 0, 0, eye)], "scene long, frame long, other long, m array<double>")
    got = warp.warp_combined(px, pairs, (8.0, 8.0, 4.0, 4.0), 8, 8).collect()
    assert len(got) == 64 and all(r["mask"] for r in got if 0 < r["u"] < 6 and 0 < r["v"] < 6)
    soft = warp.warp(px, pairs, (8.0, 8.0, 4.0, 4.0), 8, 8, soft=0.1).where("u = 3 and v = 3").first()
    assert soft["mask"] > 0.9
    assert [round(x.item(), 6) if hasattr(x, "item") else round(x, 6) for x in geo_standard(spark)] == [round((0.5 - m) / s, 6) for m, s in zip(geo.CHANNEL_MEAN, geo.CHANNEL_STD, strict=True)]


def geo_standard(spark):
    return spark.range(1).select(*geo.standardize(F.lit(0.5), F.lit(0.5), F.lit(0.5))).first()
