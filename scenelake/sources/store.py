"""Stored scenes, run summaries, reuse of results by parameters, and the point cloud sink."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scenelake.operators.masks import frame_of_label

#: Vertices of one file, which a task holds at once.
VERTICES = 1_000_000
_VERTEX = np.dtype([(n, "<f4") for n in ("x", "y", "z", "nx", "ny", "nz")] + [(n, "u1") for n in ("red", "green", "blue")])


def write_scene(df: DataFrame, path: str) -> None:
    df.write.partitionBy("scene").parquet(path)


def read_scene(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns alone are read, or all."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_frames(df: DataFrame, path: str, size: int = 16) -> None:
    """Stores rows by scene and bucket of ``size`` frames, so that a reader of one frame opens that bucket alone.

    A bucket is written by one task and sorted by frame, so its row groups are pruned by frame too; a column called
    bucket is replaced. Rows with a null frame are in a bucket of their own.
    """
    if size < 1:
        raise ValueError("size must be positive")
    df = df.withColumn("bucket", F.floor(F.col("frame") / size).cast("long"))
    df.repartition("scene", "bucket").sortWithinPartitions("scene", "bucket", "frame").write.partitionBy("scene", "bucket").parquet(path)


def read_frame(spark: SparkSession, path: str, label: str | None, size: int = 16) -> DataFrame:
    """The stored rows of the frame that a label names, in every scene, or all; ``size`` as they were written."""
    df = spark.read.parquet(path)
    frame = frame_of_label(label)
    return df.drop("bucket") if frame is None else df.where((F.col("bucket") == frame // size) & (F.col("frame") == frame)).drop("bucket")


def write_summary(df: DataFrame, path: str) -> None:
    """One row a source: name, path, elapsed, stats, error; a failed source has an error and the status FAILED."""
    df.withColumn("status", F.when(F.col("error").isNull(), "OK").otherwise("FAILED")).write.mode("append").parquet(path)


def materialize(spark: SparkSession, base: str, make: Callable[[], DataFrame], **params) -> DataFrame:
    """The result of ``make`` under a path that follows from ``params``, made only where it is not there yet."""
    digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{base.rstrip('/')}/{digest}"
    try:
        spark.read.text(f"{path}/_SUCCESS").schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _PlyWriter(DataSourceArrowWriter):
    """Tasks write whole files under temporary names; the commit gives them their own.

    Temporary names begin with the job's, so what tasks that died have left goes at the end, either way.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        store, folder = self._folder()
        store.create_dir(folder, recursive=True)
        names, held, count = [], [], 0

        def flush() -> None:
            name = f"{self.job}-{uuid.uuid4().hex}.ply"
            kinds = {"<f4": "float", "|u1": "uchar"}
            fields = "".join(f"property {kinds[_VERTEX[n].str]} {n}\n" for n in _VERTEX.names)
            with store.open_output_stream(f"{folder}/_{name}") as out:
                out.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {count}\n{fields}end_header\n".encode())
                for part in held:
                    out.write(part.tobytes())
            names.append(name)
            held.clear()

        for batch in iterator:
            for at in range(0, batch.num_rows, VERTICES):
                some = batch.slice(at, VERTICES)
                if count + some.num_rows > VERTICES:
                    flush()
                    count = 0
                rows = np.zeros(some.num_rows, _VERTEX)
                for name in ("x", "y", "z", "red", "green", "blue"):
                    rows[name] = some.column(some.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                held.append(rows)
                count += some.num_rows
        if held:
            flush()
        return _Files(names)

    def _sweep(self) -> None:
        from pyarrow import fs

        store, folder = self._folder()
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"_{self.job}-"):
                store.delete_file(info.path)

    def commit(self, messages: list[_Files | None]) -> None:
        store, folder = self._folder()
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/_{name}", f"{folder}/{name}")
        self._sweep()

    def abort(self, messages: list[_Files | None]) -> None:
        self._sweep()


class PlySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def writer(self, schema, overwrite: bool) -> _PlyWriter:
        return _PlyWriter(self.options["path"])


def write_ply(df: DataFrame, path: str) -> None:
    """Writes x, y, z and r, g, b as PLY files with zero normals, ``path`` being a URI that all executors reach.

    Colours are taken for 0..255 if any of them is over 1, else for 0..1; bytes are truncated. Null coordinates or
    colours are not points and left out.
    """
    df.sparkSession.dataSource.register(PlySink)
    top = df.agg(F.max(F.greatest("r", "g", "b"))).first()[0]
    scale = 1.0 if top is not None and top > 1 else 255.0
    byte = lambda c: F.least(F.greatest(F.col(c) * scale, F.lit(0.0)), F.lit(255.0)).cast("int")
    out = df.select(*[F.col(c).cast("float").alias(c) for c in "xyz"], byte("r").alias("red"), byte("g").alias("green"), byte("b").alias("blue"))
    out.dropna().write.format("ply").mode("append").save(path)
