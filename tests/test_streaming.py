"""Streams of small files against the same in one batch."""

import datetime as dt
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from scenelake.functions import arrays
from scenelake.operators import align, masks, trajectory
from scenelake.streaming import frames, stitching


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name).toPandas()


def source(spark, tmp_path, parts, schema):
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_interval_sample(spark, tmp_path):
    rows = [(u, i) for i in range(25) for u in ("a", "b")]
    stream = source(spark, tmp_path, [rows[:20], rows[20:]], "user string, n long")
    got = run(frames.interval_sample(stream, "user", "n", 10), tmp_path, "sampled")
    assert sorted(got[got["user"] == "a"]["n"]) == [0, 10, 20] and len(got) == 6


def test_hopping_counts(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 5, 12, 59)]
    stream = source(spark, tmp_path, [[("a", t) for t in at]], "user string, ts timestamp")
    got = run(frames.hopping_counts(stream, "user", "ts", "20 minutes", "10 minutes", late="1 minute"), tmp_path, "hops")
    assert got.sort_values("start")["n"].tolist() == [2, 3, 1]


STITCHED = "scene string, chunk long, frame long, n_frames long, ts timestamp, x array<double>, y array<double>, z array<double>, accepted array<boolean>"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(stitching.STORE[0])
    spark.conf.set(*stitching.STORE)
    yield
    spark.conf.set(stitching.STORE[0], before)


def test_stitch_equals_the_batch(spark, tmp_path, rocksdb):
    """Twelve frames in chunks of six with an overlap of three: parts of chunks, out of order, some again."""
    rng = np.random.default_rng(5)
    world = rng.normal(size=(12, 3, 8))
    turn = np.array([[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]])
    rows, pixels = [], []
    for chunk in range(3):
        for f in range(3 * chunk, 3 * chunk + 6):
            p = world[f]
            for _ in range(chunk):
                p = 1.3 * turn @ p + np.array([[1.0], [2.0], [chunk]])
            ok = [v != f % 8 for v in range(8)]
            rows.append(("s", chunk, f, 6, START, *p.tolist(), ok))
            pixels += [("s", chunk, f, 0, i, *p[:, i].tolist(), ok[i]) for i in range(8)]
    lost = [("t", 0, 0, 1, START, [1.0], [2.0], [3.0], [True]), ("t", 1, 0, 1, START, None, None, None, None), ("t", None, 0, 1, START, [1.0], [1.0], [1.0], [True]), ("t", 2, 2, 1, None, [1.0], [1.0], [1.0], [True])]
    options = trajectory.Options(2, 4, overlap=3)
    stream = source(spark, tmp_path, [rows[8:] + lost, rows[:4], rows[4:8], rows[:2]], STITCHED)
    got = run(stitching.stitch(stream, options), tmp_path, "stitched")
    own = got[got["scene"] == "s"].sort_values("frame")
    assert own["frame"].tolist() == list(range(12)) and own["chunk"].tolist() == [0] * 6 + [1] * 3 + [2] * 3
    points = spark.createDataFrame(pixels, "scene string, chunk long, frame long, v long, u long, x double, y double, z double, accepted boolean")
    placed = align.compose(align.sim3(align.overlap_moments(align.overlap_pairs(points))), points.select("scene", "chunk"))
    want = {r["chunk"]: r["m"] for r in placed.collect()}
    for _, r in own.iterrows():
        assert np.allclose(r["m"], want[r["chunk"]], atol=1e-6)
        assert np.allclose([r["x"], r["y"], r["z"]], world[r["frame"]], atol=1e-4)
    assert got[got["scene"] == "t"]["frame"].tolist() == [0] and len(got) == 13
    batch = trajectory.in_order(spark.createDataFrame(rows, STITCHED).repartition(4), None, options).toPandas().sort_values("frame")
    assert batch["frame"].tolist() == list(range(12)) and all(np.allclose(a, b) for a, b in zip(batch["x"], own["x"], strict=True))
    everything = trajectory.in_order(spark.createDataFrame(rows, STITCHED), None, options, every=True).toPandas()
    assert len(everything) == 18 and everything["again"].sum() == 6
    assert trajectory.in_order(spark.createDataFrame([], STITCHED), None, options).count() == 0


def one(chunk: int, n: int, at: int, frame: int | None = None, scene: str = "s") -> tuple:
    """A frame of one pixel so many minutes after the start."""
    return (scene, chunk, chunk if frame is None else frame, n, START + dt.timedelta(minutes=at), [1.0], [2.0], [3.0], [True])


def test_stitch_counts_late_frames(spark, tmp_path, rocksdb):
    stream = source(spark, tmp_path, [[one(0, 1, 0)], [one(0, 1, 0), one(1, 1, 0)]], STITCHED)
    got = run(stitching.stitch(stream, trajectory.Options(1, 1, overlap=0)), tmp_path, "counted_late").sort_values("chunk")
    assert got["chunk"].tolist() == [0, 1] and got["late"].tolist() == [0, 1]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_time_closes_chunks_in_any_order_of_arrival(spark, tmp_path, rocksdb, order):
    """Chunk 1 lacks a frame, chunk 2 never comes, chunk 4, the last, is incomplete: all come out, whatever came first."""
    parts = [[one(0, 1, 0)], [one(1, 2, 1)], [one(3, 1, 2)], [one(4, 2, 3)]]
    push = [[one(0, 1, 60, scene="z")], [one(1, 1, 90, scene="z")]]
    stream = source(spark, tmp_path, [parts[i] for i in order] + push, STITCHED)
    got = run(stitching.stitch(stream, trajectory.Options(1, 1, overlap=0), delay="30 minutes"), tmp_path, f"closed{order[0]}")
    assert got[got["scene"] == "s"]["chunk"].tolist() == [0, 1, 3, 4]


def test_stitch_waits_while_time_has_not_passed(spark, tmp_path, rocksdb):
    """Twenty chunks further on, chunk 1 is still waited for, and then placed with what came in between."""
    later = [[one(c, 1, 1) for c in range(2, 22)]]
    stream = source(spark, tmp_path, [[one(0, 1, 0), one(1, 2, 0)], *later, [one(1, 2, 2, frame=77)]], STITCHED)
    got = run(stitching.stitch(stream, trajectory.Options(1, 1, overlap=0), delay="1 hour"), tmp_path, "waited")
    assert got["chunk"].tolist() == [0, 1, 1, *range(2, 22)]


def test_stitch_goes_on_after_a_restart_and_ends(spark, tmp_path, rocksdb):
    """A second query on the same checkpoint goes on where the first stopped; a scene that is over starts anew."""
    options = trajectory.Options(1, 1, overlap=0)
    first = source(spark, tmp_path, [[one(0, 1, 0), one(2, 1, 0)]], STITCHED)
    assert run(stitching.stitch(first, options, idle=600_000), tmp_path / "a", "before")["chunk"].tolist() == [0]
    more = [[one(1, 1, 1)], [one(0, 1, 60, scene="z")], [one(1, 1, 90, scene="z")], [one(0, 1, 91)]]
    out = stitching.stitch(source(spark, tmp_path, more, STITCHED), options, idle=600_000)
    found = []
    q = out.writeStream.foreachBatch(lambda df, i: found.extend((r.scene, r.chunk, r.late) for r in df.collect())).option("checkpointLocation", str(tmp_path / "a" / "before")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert [r for r in found if r[0] == "s"] == [("s", 1, 0), ("s", 2, 0), ("s", 0, 0)]


def chain(rows: pd.DataFrame) -> pd.DataFrame:
    """A scorer whose answers depend on all that is handed on."""
    out = []
    for f, seed, pose, depth, ray in zip(rows["frame"], rows["input_seed"], rows["prior_pose"], rows["prior_depth"], rows["prior_ray"], strict=True):
        rng = np.random.default_rng([int(seed), int(f)])
        z = 4 + 0.01 * rng.normal(size=20) + (rng.uniform(size=20) < 0.05)
        local = np.array([(np.arange(20) % 5 - 2) / 5 * z, (np.arange(20) // 5 - 1.5) / 5 * z, z])
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        own = np.eye(4)
        own[:3, :3], own[:3, 3] = turn * np.sign(np.linalg.det(turn)), rng.normal(size=3)
        scale = 1.0 + 0.1 * int(rows["chunk"].iloc[0])
        moved = np.diag([scale, scale, scale, 1.0]) @ own
        moved[0, 3] += 1e-3 * (0 if pose is None else np.abs(pose).sum())
        conf = rng.uniform(size=20) * (1 if depth is None else 0.5 + (np.asarray(depth) > 0) / 2)
        out.append((moved.ravel(), *local, conf, [1.0 if ray is None else ray[0] * 2 + np.sum(depth)]))
    return pd.DataFrame(out, columns=["pose", "lx", "ly", "lz", "conf", "ray"])


def plain_loop(seed: int, total: int, size: int, overlap: int) -> dict:
    """Chunk after chunk in lists, for the test below."""
    out, tail, start, chunk = {}, {}, 0, 0
    while True:
        own = list(range(start, min(start + size, total)))
        prior = lambda k: [tail[f][k] if f in tail else None for f in own]  # noqa: B023, E731
        rows = pd.DataFrame({"chunk": chunk, "frame": own, "input_seed": seed})
        rows["prior_pose"], rows["prior_depth"], rows["prior_ray"] = prior("pose"), prior("prior"), prior("ray")
        found = chain(rows)
        frames = {}
        for f, r in zip(own, found.to_dict("records"), strict=True):
            local = np.array([r["lx"], r["ly"], r["lz"]])
            ok = (r["conf"] > 0.05) & (local[2] > 0)
            edge = arrays.edges(local.T.reshape(4, 5, 3), ok.reshape(4, 5)).ravel()
            conf = np.where(edge, 0, r["conf"])
            pose = np.array(r["pose"]).reshape(4, 4)
            frames[f] = {"pose": pose, "p": pose[:3, :3] @ local + pose[:3, 3:], "conf": conf, "mask": conf > 0.05, "ray": np.array(r["ray"]), "depth": local[2], "prior": np.where(conf > 0.05, local[2], 0.0)}
        assert sum(s["mask"].sum() for s in frames.values()) >= 10
        both = [(f, i) for f in own if f in tail for i in range(20) if frames[f]["mask"][i] and tail[f]["mask"][i]]
        m = align.sim3_of(np.array([frames[f]["p"][:, i] for f, i in both]).T, np.array([tail[f]["p"][:, i] for f, i in both]).T) if len(both) >= 10 else np.eye(4)
        for f, s in frames.items():
            s["p"], s["pose"] = m[:3, :3] @ s["p"] + m[:3, 3:], m @ s["pose"]
            out.setdefault(f, s)
        tail = {f: frames[f] for f in own[-overlap:]}
        if own[-1] == total - 1:
            return out
        start, chunk = start + size - overlap, chunk + 1


def test_ordered_scoring_equals_a_plain_loop_in_tables_and_streams(spark, tmp_path, rocksdb):
    rows = [(s, c, f, min(6, 14 - 4 * c), START, seed) for s, seed in (("a", 1), ("b", 2)) for c in range(3) for f in range(4 * c, min(4 * c + 6, 14))]
    schema = "scene string, chunk long, frame long, n_frames long, ts timestamp, input_seed long"
    options = trajectory.Options(4, 5, ("pose", "depth", "intrinsic"), overlap=2)
    batch = trajectory.in_order(spark.createDataFrame(rows, schema).repartition(3), chain, options).toPandas()
    stream = source(spark, tmp_path, [rows[1::2], rows[::2]], schema)
    moving = run(stitching.stitch(stream, options, chain), tmp_path, "scored")
    for got in (batch, moving):
        assert len(got) == 28
        for scene, seed in (("a", 1), ("b", 2)):
            want = plain_loop(seed, 14, 6, 2)
            own = got[got["scene"] == scene].set_index("frame")
            assert sorted(own.index) == sorted(want)
            for f, s in want.items():
                r = own.loc[f]
                assert np.allclose([r["x"], r["y"], r["z"]], s["p"]) and np.allclose(r["pose"], s["pose"].ravel()) and np.allclose(r["ray"], s["ray"])
                assert np.allclose(r["conf"], s["conf"]) and np.allclose(r["depth"], s["depth"]) and list(r["accepted"]) == s["mask"].tolist()


def test_normal_edges_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for frame in range(3):
        for v in range(6):
            for u in range(6):
                d = 0.0 if rng.random() < 0.1 else 1 + 0.02 * rng.random()
                rows.append((0, frame, dt.datetime(2024, 1, 1), v, u, d, 0.5, (u - 2.5) / 6 * d, (v - 2.5) / 6 * d))
    schema = "scene long, frame long, ts timestamp, v long, u long, d double, conf double, lx double, ly double"
    batch = spark.createDataFrame(rows, schema).selectExpr("*", "d AS lz", "d > 0 AS valid")
    want = {r["frame"]: (r["n_valid"], r["n_depth"], r["n_normal"], r["n_final"]) for r in masks.edge_counts(masks.edges(batch)).collect()}
    outside = [(0, 0, dt.datetime(2024, 1, 1), 9, 0, 1.0, 1.0, 0.0, 0.0), (0, 0, dt.datetime(2024, 1, 1), -1, 0, 1.0, 1.0, 0.0, 0.0)]
    stream = source(spark, tmp_path, [rows[:50] + outside, rows[50:], rows[:40]], schema)
    got = run(frames.frame_counts(stream, 6, 6), tmp_path, "normals_counted")
    assert len(got) == 3 and got["complete"].all()
    assert {r["frame"]: (r["n_valid"], r["n_edge"], r["n_normal"], r["n_final"]) for _, r in got.iterrows()} == want


def test_frame_counts(spark, tmp_path):
    rng = np.random.default_rng(3)
    d = np.where(rng.random((4, 4)) < 0.2, 0.0, rng.random((4, 4)) + 1)
    t = dt.datetime(2024, 1, 1)
    whole = [(0, 0, t, v, u, float(d[v, u]), 0.05 * (v + u)) for v in range(4) for u in range(4)]
    half = [(0, 1, t, v, u, 1.0, 0.5) for v in range(2) for u in range(4)]
    late = [(0, 2, t + dt.timedelta(hours=1), 0, 0, 1.0, 0.5)]
    schema = "scene long, frame long, ts timestamp, v long, u long, d double, conf double"
    stream = source(spark, tmp_path, [whole[:7] + half, whole[7:], late, late], schema)
    got = run(frames.frame_counts(stream, 4, 4), tmp_path, "counted").set_index("frame")
    edge = 0
    for v in range(4):
        for u in range(4):
            near = d[max(v - 1, 0) : v + 2, max(u - 1, 0) : u + 2]
            edge += d[v, u] > 0 and near[near > 0].max() - near[near > 0].min() > 0.03 * d[v, u]
    want = {"n_valid": int((d > 0).sum()), "n_accepted": sum(x[5] > 0 and x[6] > 0.1 for x in whole), "n_edge": edge, "complete": True}
    assert got.loc[0, list(want)].to_dict() == want
    assert got.loc[1, "n_valid"] == 8 and not got.loc[1, "complete"]
    assert isinstance(got, pd.DataFrame)
