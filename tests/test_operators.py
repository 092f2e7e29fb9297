"""Operators on awkward rows: ties, nulls, repeated rows, empty tables, and forms that no query of the plans shows."""

import io
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scenelake import params
from scenelake.functions import arrays
from scenelake.functions import geometry as geo
from scenelake.operators import align, cameras, masks, sampling, scoring, stats, warp, whole
from scenelake.sources import conditions, store
from scenelake.streaming import frames

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PX = "scene long, frame long, v long, u long, d double"


def test_quantiles_of_ties_and_large_groups(spark):
    """Eighty percent of a group are one value; what is listed in the end are distinct values of a cell, not rows."""
    df = spark.range(200_000).selectExpr("id % 2 AS g", "CASE WHEN id % 10 < 8 THEN 5.0D ELSE cast(hash(id) as double) / 1e9 END AS x")
    x = df.toPandas()
    qs = [0.0, 0.001, 0.3, 0.5, 0.999, 1.0]
    for accuracy, cells in ((10_000, 1000), (50, 4)):
        got = {r["g"]: r["quantiles"] for r in stats.exact_quantiles(df, ["g"], "x", qs, accuracy=accuracy, cells=cells).collect()}
        for g in (0, 1):
            assert np.allclose(got[g], np.quantile(x[x["g"] == g]["x"], qs), rtol=1e-12)
    assert stats.exact_quantiles(df.where("g = 7"), ["g"], "x", qs).count() == 0
    two = spark.createDataFrame([("a", 1, float("inf")), ("a", 1, 1.0), ("a", 1, float("nan")), ("a", None, 2.0)], "s string, _i int, x double")
    assert stats.exact_quantiles(two, ["s", "_i"], "x", [0.5]).select("quantiles").collect()[0][0] == [float("inf")]


def test_similarity_sums_over_frames(spark):
    unit = [0.5, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([(0, 0, unit, unit), (0, 1, unit, unit), (0, 1, None, None), (None, 0, unit, unit)], "scene long, frame long, q array<double>, k array<double>")
    assert {r["frame"]: r["score"] for r in stats.frame_similarity(df).collect()} == {0: 1.0, 1: 1.0}
    rng = np.random.default_rng(2)
    q, k = rng.normal(size=(2, 3, 4, 6))  # frames, tokens, heads * width
    rows = [(0, f, q[f, t].tolist(), k[f, t].tolist()) for f in range(3) for t in range(4)]
    got = {r["frame"]: r["score"] for r in stats.frame_similarity(spark.createDataFrame(rows, df.schema), heads=2).collect()}
    pairs = np.einsum("athd,bshd->athbs", q.reshape(3, 4, 2, 3) / np.sqrt(3), k.reshape(3, 4, 2, 3)).sum(2)
    assert np.allclose([got[f] for f in range(3)], pairs.mean((1, 3)).sum(1))
    assert stats.frame_similarity(df.limit(0)).count() == 0


def test_resampling_of_sides_that_differ(spark):
    rng = np.random.default_rng(4)
    d = rng.uniform(size=(5, 3))
    rows = [(0, 0, v, u, float(d[v, u])) for v in range(5) for u in range(3)] + [(0, 0, None, 1, 9.0), (0, 0, 9, 1, 9.0), (0, 1, 0, 0, None)]
    px = spark.createDataFrame(rows, PX)
    near = {(r["tv"], r["tu"]): r["d"] for r in sampling.resample_nearest(px, (5, 3), (2, 7)).where("frame = 0").collect()}
    assert near == {(a, b): d[a * 5 // 2, b * 3 // 7] for a in range(2) for b in range(7)}
    at = lambda t, n, m: min(max((t + 0.5) * n / m - 0.5, 0), n - 1)
    want = np.array([[sum(max(0, 1 - abs(at(a, 5, 8) - v)) * max(0, 1 - abs(at(b, 3, 2) - u)) * d[v, u] for v in range(5) for u in range(3)) for b in range(2)] for a in range(8)])
    got = {(r["tv"], r["tu"]): r["d"] for r in warp.resample_bilinear(px, (5, 3), (8, 2)).where("frame = 0").collect()}
    assert len(got) == 16 and all(np.isclose(got[k], want[k]) for k in got)
    assert warp.resample_bilinear(px.limit(0), 5, 3).count() == 0 == sampling.resample_nearest(px.limit(0), 5, 3).count()


def test_tiles_must_fill_a_frame(spark):
    good = spark.createDataFrame([(0, 28, 14)], "frame long, height long, width long")
    assert sampling.check_tiles(good).count() == 1
    with pytest.raises(Exception, match="28 x 15 are not multiples of 14"):
        sampling.check_tiles(good.withColumn("width", F.lit(15))).collect()


def test_whole_frames_equal_their_pixels(spark):
    """Frames with holes, null and NaN depths, lists of another size and repeated rows."""
    rng = np.random.default_rng(6)
    rows, px = [], []
    for f in range(4):
        d = np.where(rng.random((5, 7)) < 0.15, 0.0, 1 + 0.02 * rng.random((5, 7)))
        v, u = np.mgrid[:5, :7]
        lx, ly = (u - 3) / 7 * d, (v - 2) / 7 * d
        rows.append((0, f, d.ravel().tolist(), lx.ravel().tolist(), ly.ravel().tolist(), d.ravel().tolist(), "x"))
        px += [(0, f, int(a), int(b), float(d[a, b]), float(lx[a, b]), float(ly[a, b]), float(d[a, b]), bool(d[a, b] > 0)) for a in range(5) for b in range(7)]
    odd = [(0, 8, None, None, None, None, "x"), (0, 9, [1.0], [1.0], [1.0], [1.0], "x"), (None, None, [None] * 34 + [float("nan")], *[[0.0] * 35] * 3, "x")]
    schema = "scene long, frame long, d array<double>, lx array<double>, ly array<double>, lz array<double>, n_valid string"
    pixels = spark.createDataFrame(px, "scene long, frame long, v long, u long, d double, lx double, ly double, lz double, valid boolean")
    want = {tuple(r) for r in masks.edge_counts(masks.edges(pixels)).collect()}
    got = [tuple(r) for r in whole.edge_counts(spark.createDataFrame(rows + rows[:1] + odd, schema), 5, 7).collect()]
    assert set(got) == want | {(0, 8, 0, 0, 0, 0), (0, 9, 0, 0, 0, 0), (None, None, 0, 0, 0, 0)} and len(got) == 8
    flags = {(r["frame"], r["v"], r["u"]): (r["depth_edge"], r["normal_edge"], r["edge"]) for r in masks.edges(pixels).collect()}
    for r in whole.frame_edges(spark.createDataFrame(rows, schema), 5, 7).collect():
        assert all((r["depth_edge"][i], r["normal_edge"][i], r["edge"][i]) == flags[r["frame"], i // 7, i % 7] for i in range(35))
    assert whole.edge_counts(spark.createDataFrame([], schema), 5, 7).count() == 0
    extra = pixels.selectExpr("*", "v * 7 + u AS place", "'old' AS edge")
    outside = spark.createDataFrame([(0, 0, None, 1, 9.0, 9.0, 9.0, 9.0, True), (0, 0, 9, 0, 9.0, 9.0, 9.0, 9.0, None)], pixels.schema).selectExpr("*", "-1L AS place", "'old' AS edge")
    seen = whole.with_edges(extra.unionByName(outside), 5, 7).collect()
    assert len(seen) == len(px) + 2 and all((r["depth_edge"], r["normal_edge"], r["edge"]) == flags.get((r["frame"], r["v"], r["u"]), (False,) * 3) for r in seen)
    assert all(r["place"] == (-1 if r["v"] in (None, 9) else r["v"] * 7 + r["u"]) for r in seen)
    assert whole.with_edges(extra.limit(0), 5, 7).count() == 0
    one = np.ones((1, 1))
    assert not arrays.depth_edges(one).any() and not arrays.normal_edges(np.ones((1, 1, 3)), one > 0).any()


def test_whole_frames_of_a_batch_that_runs_twice_are_there_once(spark, tmp_path):
    schema = "scene long, frame long, d array<double>, lx array<double>, ly array<double>, lz array<double>"
    for f in range(3):
        spark.createDataFrame([(0, f, [1.0] * 4, [0.0] * 4, [0.0] * 4, [1.0] * 4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # a second query that lost the first one's checkpoint runs all batches again
        q = frames.count_whole_frames(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint), 2, 2)
        q.awaitTermination(120)
        assert q.exception() is None
        assert sorted((r["frame"], r["n_valid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 4), (1, 4), (2, 4)]


def archive(**members) -> bytes:
    out = io.BytesIO()
    np.savez(out, **members)
    return out.getvalue()


def test_archives_become_tables(spark, tmp_path):
    poses, k, depths = np.arange(32.0).reshape(2, 4, 4), np.stack([np.eye(3)] * 2), np.array([[[1, -1, np.nan]], [[np.inf, 2, 0]]])
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    whole_one = archive(poses=poses, intrinsics=k.astype(np.float32), depths=depths)
    files = {
        "a.npz": whole_one, "only.npz": archive(depths=depths.astype(np.float32), other=np.ones(3)), "shape.npz": archive(poses=np.ones((2, 3, 3)), intrinsics=k), "cut.npz": whole_one[:200],
        "empty.npz": b"", "object.npz": archive(poses=np.array([None, 1], dtype=object), intrinsics=k), "long.npz": archive(poses=poses, intrinsics=np.stack([np.eye(3)] * 3)), "text.npz": archive(poses=np.array([["a"]])), "no.txt": b"x",
    }
    for name, content in files.items():
        (folder / name).write_bytes(content)
    found = conditions.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    assert sorted((r["scene"], r["frame"], r["pose"]) for r in found["poses"].collect()) == [("a", f, poses[f].ravel().tolist()) for f in (0, 1)]
    assert sorted({r["scene"] for r in found["intrinsics"].collect()}) == ["a", "object", "shape"]
    d = {(r["scene"], r["frame"], r["v"], r["u"]): r["d"] for r in found["depths"].collect()}
    assert len(d) == 12 and [d["only", 0, 0, u] for u in range(3)] == [1.0, 0.0, 0.0] and [d["a", 1, 0, u] for u in range(3)] == [0.0, 2.0, 0.0]
    wrong = {(r["path"].rsplit("/", 1)[1], r["member"]) for r in found["quarantine"].collect()}
    assert wrong == {("shape.npz", "poses"), ("cut.npz", None), ("object.npz", "poses"), ("long.npz", None), ("text.npz", "poses")}
    (tmp_path / "none").mkdir()
    empty = conditions.convert_archives(spark, str(tmp_path / "none"), str(tmp_path / "store2"))
    assert all(t.count() == 0 for t in empty.values())


def test_poses_of_repaired_rotations(spark):
    eye = [float(i % 4 == 0) for i in range(9)]
    df = spark.createDataFrame([(0, [2 * x for x in eye], [1.0, 2.0, 3.0]), (1, None, [1.0, 2.0, 3.0]), (2, eye, [1.0]), (3, eye, None), (4, [1.0], [1.0, 2.0, 3.0])], "id long, r array<double>, t array<double>")
    got = {r["id"]: r["pose"] for r in align.repaired_poses(df).collect()}
    assert got[0] == [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0] and all(got[i] is None for i in (1, 2, 3, 4))
    views = spark.createDataFrame([(got[0],)], "m array<double>").select(geo.matmul4(geo.inverse_projection(None, F.col("m")), F.col("m")).alias("i"))
    assert np.allclose(views.first()["i"], np.eye(4).ravel())


def test_tensors_are_scored_in_bounded_batches(spark):
    def make():
        def lengths(e, w):
            assert e.ndim == 2 and e.shape[1] == 3 and len(e) == len(w) <= 4
            return np.sqrt((e * e).sum(1)) * w

        return lengths

    rows = [(i, [float(i), 0.0, 1.0], 2.0) for i in range(11)] + [(11, None, 1.0), (12, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "id long, e array<double>, w double")
    got = {r["id"]: r["score"] for r in scoring.score_tensors(df, make, {"e": [3], "w": None}, "score", DoubleType(), size=4).collect()}
    assert np.allclose([got[i] for i in range(11)], [2 * np.hypot(i, 1) for i in range(11)]) and got[11] is got[12] is None
    with pytest.raises(ValueError):
        scoring.score_tensors(df, make, {"e": [3]}, "score", DoubleType(), size=0)


def test_warp_needs_the_intrinsics_of_both_frames(spark):
    px = spark.createDataFrame([(0, f, 0, 0, 1.0) for f in (0, 1)], PX)
    pairs = spark.createDataFrame([(0, 0, 1, np.eye(4).ravel().tolist()), (0, 1, 0, np.eye(4).ravel().tolist())], "scene long, frame long, other long, m array<double>")
    k = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.5, 0.0, 1.0, 0.5, 0.0, 0.0, 1.0])], "scene long, frame long, k array<double>")
    assert warp.warp(px, pairs, k, 4, 4).count() == 0
    assert warp.warp(px, pairs, k.union(k.withColumn("frame", F.lit(1))), 4, 4).count() == 2


def test_columns_named_like_helpers_stay(spark):
    """Whatever a user's columns are called, they come back as they were."""
    names = ["_most", "_LEAST", "_p", "_up", "_n", "_n0", "_row", "_angle", "_u0", "_few", "_first", "_place", "_last", "_conf", "_b", "_raw", "_inverse", "kept_most"]
    px = spark.createDataFrame([(0, 0, v, u, 1.0 + v * u) for v in range(3) for u in range(3)], PX)
    px = px.selectExpr("*", "d AS lx", "d AS ly", "d AS lz", "d > 0 AS valid", "d / 9 AS conf", "0L AS chunk", "d > 4 AS accepted", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    frames_ = spark.createDataFrame([(0, f, [float(i % 5 == 0) for i in range(16)]) for f in range(3)], "scene long, frame long, pose array<double>").selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    scales = spark.createDataFrame([(0, 0.5)], "scene long, raw double")
    made = [
        masks.edges(px), masks.top_share(px), sampling.interval_sample(px, "scene", ["v", "u"], 2), sampling.assign_chunks(px.drop("chunk"), 4, 2), warp.mask_priors(px, px, 0.5),
        stats.stretch_depth(px), cameras.metric_points(px, scales), cameras.metric_poses(frames_, scales), cameras.relative_poses(frames_),
    ]
    for out in made:
        rows = out.select(*[F.col(f"`{n}`") for n in names]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(names)))]
    by_name = masks.depth_edges(px.withColumnRenamed("d", "_d"), depth="_d").where("depth_edge").count()
    assert by_name == masks.depth_edges(px).where("depth_edge").count() > 0
    factors = stats.normalize_depth(px.withColumn("factor", F.lit(9.0)))
    assert factors.columns.count("factor") == 1 and factors.count() == 9


def test_parameters_reach_the_operators(spark):
    p = params.Parameters(conf=0.3, chunk_conf=0.2, pixel_limit=28 * 28, overlap=3, inject=("ray",))
    o = p.options(4, 5)
    assert (o.height, o.width, o.kinds, o.overlap, o.threshold, o.rtol, o.degrees) == (4, 5, ("ray",), 3, 0.2, 0.03, 5.0)
    row = spark.range(1).select(*p.target(F.lit(1000), F.lit(1000)), p.sure(F.lit(0.3)).alias("no"), p.sure(F.lit(0.31)).alias("yes")).first()
    assert tuple(row) == (28, 28, False, True)


def test_one_frame_reads_one_bucket(spark, tmp_path):
    rows = [(s, f, v, f"x{f}") for s in (0, 1) for f in range(40) for v in range(3)] + [(0, None, 0, "n")]
    df = spark.createDataFrame(rows, "scene long, frame long, v long, bucket string").repartition(6)
    store.write_frames(df, str(tmp_path / "f"), 10)
    got = store.read_frame(spark, str(tmp_path / "f"), "23: b.png", 10)
    assert got.columns == ["frame", "v", "scene"] and sorted((r["scene"], r["frame"], r["v"]) for r in got.collect()) == [(s, 23, v) for s in (0, 1) for v in range(3)]
    files = {r[0] for r in got.select(F.input_file_name()).collect()}
    assert len(files) == 2 and all("/bucket=2/" in f for f in files)
    opened = [p for p in got._jdf.queryExecution().executedPlan().collectLeaves().mkString("|").split("|") if "bucket" in p]
    assert any("PartitionFilters" in p and "bucket" in p for p in opened)
    assert store.read_frame(spark, str(tmp_path / "f"), "All", 10).count() == len(rows)


def test_rejected_pixels_go(spark):
    px = spark.createDataFrame([(0, 0, v, 0, 1.0) for v in range(3)] + [(0, 0, None, 0, 1.0)], PX)
    rejected = spark.createDataFrame([(0, 0, 1, 0), (0, 0, 1, 0), (None, 0, 0, 0)], "scene long, frame long, v long, u long")
    assert [r["v"] for r in masks.without(px, rejected).orderBy("v").collect()] == [None, 0, 2]
    assert masks.without(px, rejected.limit(0)).count() == 4


def test_overlaps_stand_side_by_side(spark):
    """Pairs and moments against plain loops, with a chunk that is missing, pixels far from the origin and repeated rows."""
    rng = np.random.default_rng(9)
    rows = [("s", c, f, 0, u, *(1e4 + rng.normal(size=3)).tolist(), bool(rng.random() < 0.8)) for c in (0, 1, 2, 4) for f in range(c, c + 3) for u in range(12)]
    df = spark.createDataFrame(rows + [("s", 1, 2, 0, 0, 1.0, 1.0, 1.0, None)], "scene string, chunk long, frame long, v long, u long, x double, y double, z double, accepted boolean")
    have = {(r[1], r[2], r[4]): np.array(r[5:8]) for r in rows if r[8]}
    got = {r["chunk"]: r for r in align.overlap_moments(align.overlap_pairs(df)).collect()}
    assert sorted(got) == [1, 2]
    for c in (1, 2):
        keys = [(f, u) for (k, f, u) in have if k == c and (c - 1, f, u) in have]
        s, t = (np.array([have[k, f, u] for f, u in keys]) for k in (c, c - 1))
        n = len(keys)
        ms, mt = s.sum(0) / (n + 1e-6), t.sum(0) / (n + 1e-6)
        h = (s - ms).T @ (t - mt)
        assert got[c]["n"] == n and np.allclose([got[c][f"ms{a}"] for a in "xyz"], ms) and np.allclose([got[c][f"mt{a}"] for a in "xyz"], mt)
        assert np.allclose([[got[c][f"h{i}{j}"] for j in range(3)] for i in range(3)], h, atol=1e-5) and np.isclose(got[c]["square"], ((s - ms) ** 2).sum(), atol=1e-5)
    assert align.overlap_moments(align.overlap_pairs(df.limit(0))).count() == 0


def test_stencils_take_nulls_repeats_and_nothing(spark):
    rows = [(0, 0, v, u, None if (v, u) == (1, 1) else 1.0 + v * u, 1.0, 1.0, 1.0, None if (v, u) == (2, 2) else True) for v in range(3) for u in range(3)]
    rows += [(0, 0, 0, 0, 1.0, 1.0, 1.0, 1.0, True), (0, 0, None, 0, 1.0, 1.0, 1.0, 1.0, True)]
    px = spark.createDataFrame(rows, "scene long, frame long, v long, u long, d double, lx double, ly double, lz double, valid boolean")
    got = masks.edges(px)
    by_place = {(r["v"], r["u"]): r for r in got.collect()}
    assert got.count() == len(rows) and all(r[c] is not None for r in by_place.values() for c in ("depth_edge", "has_normal", "normal_edge", "edge"))
    assert not by_place[2, 2]["has_normal"] and by_place[1, 1]["depth_edge"] and not by_place[None, 0]["edge"]
    counts = masks.edge_counts(got).first()
    assert counts["n_valid"] == 10 and counts["n_final"] <= min(counts["n_depth"], counts["n_normal"])
    none = px.limit(0).selectExpr("*", "d AS conf", "0L AS chunk", "valid AS accepted")
    for out in (masks.edges(none), masks.edge_counts(masks.edges(none)), masks.top_share(none), stats.stretch_depth(none), sampling.tile_stats(none, 2), warp.mask_priors(none, none, 0.5), stats.recover_intrinsics(none, 2, 2), sampling.assign_chunks(none.drop("chunk"))):
        assert out.count() == 0


def test_warps_gather_frames_once(spark):
    """Pixels are never multiplied by their corners: no row is exploded, and both modes share one pass."""
    rng = np.random.default_rng(5)
    rows = [(0, f, v, u, float(1 + 0.02 * rng.random())) for f in (0, 1) for v in range(4) for u in range(5) if (f, v, u) not in ((1, 2, 2), (0, 3, 3))]
    rows += [(0, 1, 1, 1, 0.5), (0, 0, 3, 3, None), (0, 0, None, 3, 1.0), (0, 0, 0, 9, 1.0), (0, 0, 2, 1, rows[11][4])]  # repeated, null, outside, repeated
    px = spark.createDataFrame(rows, PX)
    m = np.eye(4)
    m[:2, 3] = 0.3, -0.2
    pairs = spark.createDataFrame([(0, 0, 1, m.ravel().tolist()), (0, 1, 0, None), (0, 1, 7, np.eye(4).ravel().tolist())], "scene long, frame long, other long, m array<double>")
    out = warp.warp_combined(px, pairs, (5.0, 4.0, 2.5, 2.0), 4, 5)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["frame"], r["other"], r["v"], r["u"]): r for r in out.collect()}
    assert len(got) == len(out.collect()) == len({r[2:4] for r in rows if r[1] == 0}) + 2 * len({r[2:4] for r in rows if r[1] == 1})
    grid = np.zeros((4, 5))
    for _, f, v, u, d in rows:
        if f == 1:
            grid[v, u] += d
    for (v, u) in {r[2:4] for r in rows if r[1] == 0}:
        r, ds = got[0, 1, v, u], [x[4] for x in rows if x[1:4] == (0, v, u)]
        if v is None or None in ds:
            assert r["wx"] is None and not r["mask"] and r["error"] == float("inf")
            continue
        z, x, y = ds[0], (u + 0.5 - 2.5) / 5 * ds[0] + 0.3, (v + 0.5 - 2) / 4 * ds[0] - 0.2
        at_x, at_y = (5 * x + 2.5 * z) / (z + 1e-4), (4 * y + 2 * z) / (z + 1e-4)
        seen = len(ds) * sum(max(0, 1 - abs(at_y - 0.5 - i)) * max(0, 1 - abs(at_x - 0.5 - j)) * grid[i, j] for i in range(4) for j in range(5))
        inside = 0 < at_x < 4 and 0 < at_y < 3
        assert r["linear"] == (inside and seen != 0 and abs((seen - z) / seen) < 0.05)
        near = len(ds) * (grid[int(np.floor(at_y)), int(np.floor(at_x))] if 0 <= at_y < 4 and 0 <= at_x < 5 else 0.0)
        assert r["mask"] == (r["linear"] or (inside and near != 0 and abs((near - z) / near) < 0.05))
        assert np.isclose(r["wx"], 2 * at_x / 5 - 1) and np.isclose(r["wy"], 2 * at_y / 4 - 1)
    assert any(r["mask"] for r in got.values()) and all(r["wx"] is None for k, r in got.items() if k[:2] == (1, 0))
    assert all(r["error"] == float("inf") for k, r in got.items() if k[:2] == (1, 7))  # nothing is seen in a frame without pixels


def test_whole_frames_are_worked_on_in_small_parts():
    import tracemalloc

    from scenelake.functions import arrays

    n = whole.PIXELS // 64
    points, valid = np.random.default_rng(1).random((8, 8, n, 3)), np.ones((8, 8, n), bool)
    tracemalloc.start()
    try:
        arrays.depth_edges(points[..., 2])
        arrays.normal_edges(points, valid)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_stencils_deal_frames_to_more_tasks(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 1.0)], PX)
    parts = masks.SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert masks.by_frame(px).rdd.getNumPartitions() == parts == 32
