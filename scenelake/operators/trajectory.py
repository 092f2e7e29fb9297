"""Chunks of a scene placed one after another: one machine for tables and for streams.

A chunk is a run of frames that a scorer of the user's sees at once, or whose points are known already. Its first frames
are the last ones of the chunk before. Accepted pixels of these give the similarity that takes the chunk to the scene,
and what was found for them, moved there, can be handed on to the scorer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import arrays
from scenelake.operators.align import sim3_of

#: What a frame of a placed chunk has, and the type of each in a table.
FIELDS = {
    "pose": "array<double>", "x": "array<double>", "y": "array<double>", "z": "array<double>", "depth": "array<double>", "conf": "array<double>", "ray": "array<double>",
    "accepted": "array<boolean>",
}
KINDS = ("pose", "depth", "ray")


def injected(inject: tuple[str, ...]) -> list[str]:
    """The kinds of priors that are meant; intrinsic is another name for ray."""
    if unknown := set(inject) - {*KINDS, "intrinsic"}:
        raise ValueError(f"cannot inject {sorted(unknown)}")
    return [k for k in KINDS if k in inject or (k == "ray" and "intrinsic" in inject)]


@dataclass(frozen=True)
class Options:
    """``height`` and ``width`` of frames, for edges; ``inject``: kinds of priors; ``overlap``: frames that chunks share;
    ``threshold`` on confidence; ``rtol`` and ``degrees`` of edges; ``least`` accepted pixels, of a chunk for its mask
    and of an overlap for a similarity; ``share``: each frame's part of pixels that is taken where a chunk has fewer."""

    height: int
    width: int
    inject: tuple[str, ...] = ()
    overlap: int = 6
    threshold: float = 0.05
    rtol: float = 0.03
    degrees: float = 5.0
    least: int = 10
    share: float = 0.1
    kinds: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "kinds", tuple(injected(self.inject)))


def numbers(values: list | np.ndarray | None, size: int | None = None) -> np.ndarray:
    """An array of numbers, null ones NaN; of another size than asked for, all NaN."""
    if values is None:
        return np.full(size or 0, np.nan)
    out = np.array([np.nan if v is None else v for v in values], float)
    return out if size is None or len(out) == size else np.full(size, np.nan)


def scored(rows: pd.DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], tail: dict[int, dict], o: Options) -> dict[int, dict]:
    """The frames of a chunk as the scorer sees them, with what ``tail`` hands on as prior_pose, prior_depth and
    prior_ray (None for frames that are new): aligned poses, and depths that are 0 where the confidence, which is 0 at
    edges, is not above the threshold."""
    rows, n = rows.sort_values("frame", ignore_index=True), o.height * o.width
    for kind in o.kinds:
        rows[f"prior_{kind}"] = pd.Series([None if (seen := tail.get(f)) is None else np.where(seen["conf"] > o.threshold, seen["depth"], 0.0) if kind == "depth" else seen[kind] for f in rows["frame"]], dtype=object)
    found, out = scorer(rows), {}
    for f, row in zip(rows["frame"], found.to_dict("records"), strict=True):
        local, conf = np.stack([numbers(row[c], n) for c in ("lx", "ly", "lz")]), numbers(row["conf"], n)
        pose = numbers(row["pose"], 16).reshape(4, 4)
        sure = np.isfinite(local).all(0) & (local[2] > 0) & (conf > o.threshold)
        edge = arrays.edges(local.T.reshape(o.height, o.width, 3), sure.reshape(o.height, o.width), o.rtol, o.degrees).ravel()
        conf = np.where(edge, 0.0, conf)
        ray = None if row.get("ray") is None else numbers(row["ray"])
        out[int(f)] = {"pose": pose, "points": pose[:3, :3] @ local + pose[:3, 3:], "depth": local[2], "conf": conf, "ray": ray, "accepted": conf > o.threshold}
    if sum(s["accepted"].sum() for s in out.values()) < o.least:
        k = int(n * o.share)
        for s in out.values():
            s["accepted"] = s["conf"] >= np.sort(np.where(np.isnan(s["conf"]), -np.inf, s["conf"]))[-k] if k else np.zeros(n, bool)
    return out


def given(rows: pd.DataFrame) -> dict[int, dict]:
    """The frames of a chunk whose x, y, z and accepted pixels are columns already, with a pose if there is one.

    A pixel with a null or a number that is not finite is not accepted; a frame with a null column has no pixels.
    """
    out = {}
    for row in rows.to_dict("records"):
        if any(row[c] is None for c in ("x", "y", "z", "accepted")):
            points, accepted = np.zeros((3, 0)), np.zeros(0, bool)
        else:
            points = np.stack([numbers(row[c]) for c in "xyz"])
            accepted = np.array([bool(v) for v in row["accepted"]], bool) & np.isfinite(points).all(0)
        pose = None if row.get("pose") is None else numbers(row["pose"], 16).reshape(4, 4)
        out.setdefault(int(row["frame"]), {"pose": pose, "points": points, "depth": None, "conf": None, "ray": None, "accepted": accepted})
    return dict(sorted(out.items()))


def similarity(frames: dict[int, dict], tail: dict[int, dict], least: int) -> np.ndarray:
    """Takes a chunk to the scene by the pixels that it and the tail, which is there already, accept in common.

    With fewer than ``least`` of them it stands in the scene's frame itself.
    """
    pairs = [(s["points"][:, both], t["points"][:, both]) for f, s in frames.items() if (t := tail.get(f)) and s["points"].shape == t["points"].shape for both in [s["accepted"] & t["accepted"]]]
    source, target = (np.concatenate([p[i] for p in pairs] or [np.zeros((3, 0))], axis=1) for i in (0, 1))
    return sim3_of(source, target, least) if source.shape[1] >= max(1, least) else np.eye(4)


def placed(frames: dict[int, dict], tail: dict[int, dict], overlap: int, least: int) -> tuple[np.ndarray, dict[int, dict], dict[int, dict]]:
    """The chunk's similarity, its frames in the scene, and the last of them, the tail for the next chunk."""
    m = similarity(frames, tail, least)
    moved = {f: s | {"points": m[:3, :3] @ s["points"] + m[:3, 3:], "pose": None if s["pose"] is None else m @ s["pose"]} for f, s in frames.items()}
    return m, moved, {f: moved[f] for f in sorted(moved)[max(0, len(moved) - overlap) :]}


def flat(seen: dict) -> tuple:
    """A frame as the values of FIELDS."""
    plain = lambda a: None if a is None else a.ravel().tolist()
    return (plain(seen["pose"]), *seen["points"].tolist(), plain(seen["depth"]), plain(seen["conf"]), plain(seen["ray"]), seen["accepted"].tolist())


def unflat(values: tuple) -> dict:
    row = dict(zip(FIELDS, values, strict=True))
    some = lambda name, shape=-1: None if row[name] is None else np.array(row[name], float).reshape(shape)
    points = np.array([row["x"], row["y"], row["z"]], float).reshape(3, -1)
    return {"pose": some("pose", (4, 4)), "points": points, "depth": some("depth"), "conf": some("conf"), "ray": some("ray"), "accepted": np.array(row["accepted"], bool)}


def in_order(chunked: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None, options: Options, every: bool = False) -> DataFrame:
    """scene, chunk, frame, again, m and FIELDS: every frame once, in the frame of its scene's first chunk.

    ``chunked`` has scene, chunk, frame and, for the scorer, columns whose names begin with input_; without a scorer
    (None) x, y, z, accepted and, if wanted, pose. The scorer gets the rows of a chunk in frame order, with the priors
    of ``options.inject``, and returns as many in that order: pose (16 numbers), lx, ly, lz and conf of each pixel by
    rows and, if rays are injected, ray. With ``every`` the frames that a chunk repeats come too, ``again`` true.

    A chunk needs what was found for the one before, so a scene is one chain. Scenes are dealt to tasks; a task reads
    its rows in the order of chunks, holding one chunk and the tail of the last, however long a scene is. Chunks that
    are missing are passed over. Of rows that repeat scene, chunk and frame the first counts; rows with a null chunk or
    frame are left out; a null scene is a scene. Pixels with nulls are not accepted. An empty table gives no rows.
    """
    scene = dict(chunked.dtypes)["scene"]
    inputs = [c for c in chunked.columns if c.startswith("input_")] if scorer else [c for c in ("x", "y", "z", "accepted", "pose") if c in chunked.columns]
    out = f"scene {scene}, chunk long, frame long, again boolean, m array<double>, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
    names = ["scene", "chunk", "frame", "again", "m", *FIELDS]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tail, held = None, {}, []

        def finish() -> pd.DataFrame:
            nonlocal tail
            rows = pd.concat(held).drop_duplicates("frame")
            frames = scored(rows, scorer, tail, options) if scorer else given(rows)
            before = tail
            m, moved, tail = placed(frames, before, options.overlap, options.least)
            rows = [(at[1], at[2], f, f in before, m.ravel().tolist(), *flat(s)) for f, s in moved.items() if every or f not in before]
            return pd.DataFrame(rows, columns=names)

        for part in parts:
            for key, rows in part.groupby(["_null", "scene", "chunk"], sort=False, dropna=False):
                null, s, chunk = key
                own = (bool(null), None if null else s, int(chunk))
                if at is not None and own != at:
                    yield finish()
                    held = []
                    if own[:2] != at[:2]:
                        tail = {}
                at = own
                held.append(rows.drop(columns="_null"))
        if held:
            yield finish()

    rows = chunked.where("chunk IS NOT NULL AND frame IS NOT NULL").select("scene", F.col("chunk").cast("long").alias("chunk"), F.col("frame").cast("long").alias("frame"), *inputs)
    rows = rows.repartition("scene").sortWithinPartitions("scene", "chunk", "frame").withColumn("_null", F.col("scene").isNull())
    return rows.mapInPandas(run, out)
