"""Archives of priors (.npz) as tables, read and checked in tasks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of an archive, and the shape of a frame's part of each (None: any sides).
MEMBERS = {"poses": (4, 4), "intrinsics": (3, 3), "depths": (None, None)}

_OUT = "path string, kind string, frame long, height long, width long, numbers array<double>, error string"


def _rows(path: str, content: bytes) -> Iterator[tuple]:
    """A row for each frame of each member, or for each fault. Members that are absent or None are no fault."""
    try:
        archive = np.load(io.BytesIO(content), allow_pickle=False)
        if not isinstance(archive, np.lib.npyio.NpzFile):
            raise ValueError("not an archive")
    except (ValueError, OSError, EOFError, zipfile.BadZipFile) as e:
        yield path, None, None, None, None, None, f"unreadable: {e}"
        return
    lengths = {}
    for kind, shape in MEMBERS.items():
        if kind not in archive.files:
            continue
        try:
            values = archive[kind]
        except (ValueError, OSError, EOFError, zipfile.BadZipFile) as e:
            yield path, kind, None, None, None, None, f"unreadable: {e}"
            continue
        fits = values.ndim == 3 and all(want in (None, have) for want, have in zip(shape, values.shape[1:], strict=True))
        if not fits or values.dtype.kind not in "fiu":
            yield path, kind, None, None, None, None, f"{values.dtype} of shape {values.shape}"
            continue
        lengths[kind] = len(values)
        for frame, part in enumerate(values):
            yield path, kind, frame, *part.shape, part.astype(float).ravel().tolist(), None
    if len(set(lengths.values())) > 1:
        yield path, None, None, None, None, None, f"members differ in length: {lengths}"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "kind", "frame", "height", "width", "numbers", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held, size = [], 0
            for row in _rows(path, content or b""):
                held.append(row)
                size += len(row[5] or ())
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)


def convert_archives(spark: SparkSession, path: str, store: str) -> dict[str, DataFrame]:
    """Tables poses and intrinsics (scene, frame, pose or k), depths (scene, frame, v, u, d) and quarantine (path,
    member, error) of the archives under ``path``, written once under ``store``.

    A scene is an archive's name without its ending. Members that are absent leave their frames without that prior; one
    of a wrong shape or type, or that cannot be read, goes to quarantine while the others stay; so does an archive that
    cannot be read, or whose members have different numbers of frames, and then none of its members counts. Depths that
    are not finite or not positive become 0. Objects in archives are never loaded. Without archives the tables are
    empty, and files without a byte are passed over, as Spark does not read them. A frame of depths is one list until it
    is split into pixels, and an archive is read by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    files.select("path", "content").mapInArrow(_parsed, _OUT).write.mode("overwrite").partitionBy("kind").parquet(f"{store.rstrip('/')}/parsed")
    schema = _OUT.replace("kind string, ", "") + ", kind string"
    parsed = spark.read.schema(schema).parquet(f"{store.rstrip('/')}/parsed")
    wrong = parsed.where("error IS NOT NULL").select("path", F.col("kind").alias("member"), "error")
    broken = wrong.where("member IS NULL").select("path").distinct()
    scene = F.regexp_extract("path", r"([^/]*)\.npz$", 1).alias("scene")
    good = parsed.where("error IS NULL").join(broken, "path", "left_anti")
    part = lambda kind: good.where(F.col("kind") == kind)
    d = F.col("d")
    depths = part("depths").select(scene, "frame", "width", F.posexplode("numbers").alias("i", "d"))
    depths = depths.select("scene", "frame", F.expr("i div width").alias("v"), (F.col("i") % F.col("width")).alias("u"), F.when(~F.isnan(d) & (d > 0) & (d < float("inf")), d).otherwise(0.0).alias("d"))
    return {"poses": part("poses").select(scene, "frame", F.col("numbers").alias("pose")), "intrinsics": part("intrinsics").select(scene, "frame", F.col("numbers").alias("k")), "depths": depths, "quarantine": wrong}
