"""Every scene query against its SQL on the small tables, and planted transforms."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from scenelake import params
from scenelake.functions import geometry as geo
from scenelake.operators import align, masks, sampling, stats, trajectory
from scenelake.plans import scene, views

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "events", "lineitem", "nation", "part", "supplier")
QUERIES, SQL = scene.QUERIES | views.QUERIES, scene.SQL | views.SQL


def rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = rows(con.execute(SQL[name]).df())
    got = rows(QUERIES[name](spark, SF).toPandas())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype == float or want[c].dtype == float:
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1.01e-4, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("n", [1, 6, 16, 17, 26, 27, 45])
def test_chunks_equal_the_loop(spark, n):
    want, start, chunk = [], 0, 0
    while True:
        want += [(f, chunk) for f in range(start, min(start + 16, n))]
        if start + 16 >= n:
            break
        start, chunk = start + 10, chunk + 1
    got = sampling.assign_chunks(spark.range(n).selectExpr("0 AS scene", "id AS frame")).select("frame", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_planted_similarity(spark):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    s = rng.normal(size=(200, 3))
    t = 1.7 * s @ q.T + [1, -2, 3]
    pairs = spark.createDataFrame(pd.DataFrame({"scene": 0, "chunk": 1, **{f"s{c}": s[:, i] for i, c in enumerate("xyz")}, **{f"t{c}": t[:, i] for i, c in enumerate("xyz")}}))
    m = np.array(align.sim3(align.overlap_moments(pairs)).first()["m"]).reshape(4, 4)
    assert np.allclose(m[:3, :3], 1.7 * q, atol=1e-6) and np.allclose(m[:3, 3], [1, -2, 3], atol=1e-6)
    few = align.sim3(align.overlap_moments(pairs.limit(9))).first()["m"]
    assert few == np.eye(4).ravel().tolist()


def test_rotations_are_proper(spark):
    out = scene.rotation_repair(spark, SF).toPandas()
    assert (out["det"] == 1).all()


def test_ordered_scoring_rejects_unknown_priors(spark):
    with pytest.raises(ValueError):
        trajectory.Options(8, 8, ("colour",))
    assert trajectory.Options(8, 8, ("intrinsic", "pose")).kinds == ("pose", "ray")


def test_sql_functions_equal_the_operators(spark):
    sampling.register_functions(spark)
    frames = spark.range(45).selectExpr("0L AS scene", "id AS frame")
    frames.createOrReplaceTempView("few_frames")
    got = spark.sql("SELECT frame, c.chunk, c.pos FROM few_frames, LATERAL chunk_ids(frame, 45, 16, 6) c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.assign_chunks(frames).select("frame", "chunk", "pos").collect()))
    grid = spark.sql("SELECT * FROM pixel_grid(2, 3)").collect()
    assert sorted(map(tuple, grid)) == sorted(map(tuple, sampling.pixel_grid(spark.range(1), 2, 3).select("v", "u", "px", "py", "pw").collect()))


def test_rotation_repair_and_inverse_take_nulls(spark):
    eye = [float(i % 4 == 0) for i in range(9)]
    df = spark.createDataFrame([(0, eye), (1, None), (2, [1.0]), (3, [float("nan")] * 9)], "id long, r array<double>")
    got = {r["id"]: r for r in align.repair_rotations(df).collect()}
    assert got[0]["rotation"] == eye and not got[0]["repaired"]
    assert all(got[i]["rotation"] is None and got[i]["residual"] is None and not got[i]["repaired"] for i in (1, 2, 3))
    m = spark.createDataFrame([(0, np.diag([2.0, 4.0, 1.0, 1.0]).ravel().tolist()), (1, None), (2, [0.0] * 16), (3, [float("inf")] * 16)], "id long, m array<double>")
    out = {r["id"]: r["i"] for r in m.select("id", geo.inverse4("m").alias("i")).collect()}
    assert out[0][0] == 0.5 and out[0][5] == 0.25 and out[1] is out[2] is out[3] is None


def test_labels_name_frames():
    assert [masks.frame_of_label(x) for x in ("3: a.png", "All", None, "x: 3", " 12 ", "")] == [3, None, None, None, 12, None]


def test_parameters(spark):
    p = params.Parameters()
    assert [p.step("a.MP4"), p.step("a"), p.step("a", 29.9), params.Parameters(interval=3).step("a.mp4")] == [10, 1, 29, 3]
    frames = spark.range(45).selectExpr("0 AS scene", "id AS frame")
    assert sampling.assign_chunks(frames, **p.chunks()).count() == sampling.assign_chunks(frames).count()
    for bad in ({"overlap": 16}, {"inject": ("colour",)}):
        with pytest.raises(ValueError):
            params.Parameters(**bad)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 500])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 1)  # with ties
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(0, None), (1, 7.0), (2, None)], "g int, x double")
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for accuracy in (10_000, 20):
        got = {r["g"]: r["quantiles"] for r in stats.exact_quantiles(df, ["g"], "x", qs, accuracy=accuracy).collect()}
        assert np.allclose(got[0], np.quantile(x, qs)) and got[1] == [7.0] * 5 and 2 not in got
        low = stats.exact_quantiles(df, ["g"], "x", [0.5], lower=True, accuracy=accuracy).where("g = 0").first()["quantiles"]
        assert low == [np.sort(x)[(n - 1) // 2]]


def test_similarities_have_no_bias(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    s = 0.5 * rng.normal(size=(20, 3)) + [40, -30, 20]
    t = 1.7 * s @ q.T + [1, -2, 3]
    pairs = spark.createDataFrame(pd.DataFrame({"scene": 0, "chunk": 1, **{f"s{c}": s[:, i] for i, c in enumerate("xyz")}, **{f"t{c}": t[:, i] for i, c in enumerate("xyz")}}))
    for m in (align.sim3_of(s.T, t.T), np.array(align.sim3(align.overlap_moments(pairs)).first()["m"]).reshape(4, 4)):
        assert np.allclose(m[:3, :3], 1.7 * q, rtol=0, atol=1e-11) and np.allclose(m[:3, 3], [1, -2, 3], rtol=0, atol=1e-9)
    assert not align.sim3_of(np.ones((3, 20)) * 0.1, t.T)[:3, :3].any()  # a source of one point has no scale
