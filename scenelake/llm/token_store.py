"""Token ids in Arrow files of equal-length sequences, with masks, for random access without copies.

A store is a folder. ``part-NNNNN.arrow`` is an Arrow IPC file whose batches have two fixed-size-list columns, ``ids``
(uint16 where the vocabulary allows it, else uint32) and ``mask`` (false on the padding that ends a file), all of the
same number of sequences but the last; so sequence i of a file lies at a known place of a known batch. A document may
cross sequences, not files. ``index-NNNNN.arrow`` says where each document of the file starts. ``manifest`` is a
Parquet table with the number of documents and ids of each file. Files follow each other in ascending order of ids.

Any path works that Spark and pyarrow's file systems both open (file, hdfs, s3, gs); all executors must reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import bounded_batches, crc32, keyed_texts, partitions, slices, unkey
from scenelake.llm.encode import encoder

#: Sequences in each batch of a file.
BATCH_SEQUENCES = 64
_INDEX = pa.schema([("k", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return (pafs.LocalFileSystem(use_mmap=True), path) if isinstance(fs, pafs.LocalFileSystem) else (fs, path)


class _Sequences:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind, self.held, self.n_held, self.total = length, kind, [], 0, 0
        self.size = BATCH_SEQUENCES * length
        lists = lambda t: pa.list_(t, length)
        self.schema = pa.schema([("ids", lists(pa.from_numpy_dtype(kind))), ("mask", lists(pa.bool_()))])
        self.writer = ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.size:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - self.size + 1, self.size):
                self._write(flat[at : at + self.size], self.size)
            rest = flat[len(flat) - len(flat) % self.size :]
            self.held, self.n_held = [rest], len(rest)

    def _write(self, flat: np.ndarray, n: int) -> None:
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
        self.writer.write_batch(pa.record_batch([lists(flat), lists(np.arange(len(flat)) < n)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to a file of sequences; ids are views of the file wherever they lie in one batch."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.reader = ipc.open_file(fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.size = BATCH_SEQUENCES * self.length

    def _flat(self, batch: int) -> np.ndarray:
        return self.reader.get_batch(batch).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence."""
        batch, row = self.reader.get_batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        mask = batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
        return batch.column("ids").slice(row, 1).flatten().to_numpy(zero_copy_only=True), mask

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids from one place of the file to another."""
        parts = []
        while start < stop:
            batch, at = divmod(start, self.size)
            parts.append(self._flat(batch)[at : at + stop - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def write_store(docs: DataFrame, path: str, tokenizer: str, length: int = 2048, end_id: int = 2) -> DataFrame:
    """Encodes whole texts in ascending order of doc_id, each followed by ``end_id``; returns the manifest.

    ``tokenizer`` is the path of a vocabulary file, or the bare name of a public one, found on each executor. A null
    text is empty and yields the end id alone; a null id comes first; an empty table gives an empty store. Each task
    writes its own two files under other names and renames them, so a task that runs again leaves the same files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if max(enc.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
        fs, root = _opened(path)
        fs.create_dir(root)
        own, end = f"{TaskContext.get().taskAttemptId()}.tmp", np.array([end_id], "<u4").tobytes()
        n_docs, names = 0, [f"_{of}-{part:05d}-{own}" for of in ("part", "index")]
        with fs.open_output_stream(f"{root}/{names[0]}") as sink, fs.open_output_stream(f"{root}/{names[1]}") as side:
            sequences = _Sequences(sink, length, kind)
            with ipc.new_file(side, _INDEX) as index:
                for batch in batches:
                    for some in slices(batch):
                        found = enc.encode([b.decode() for b in some.column(1).to_pylist()])
                        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4 + 1
                        places = sequences.total + np.cumsum(sizes) - sizes
                        index.write_batch(pa.record_batch([some.column(0), pa.array(places), pa.array(sizes)], schema=_INDEX))
                        sequences.add(np.frombuffer(end.join([*found, b""]), "<u4"))
                        n_docs += len(found)
            sequences.close()
        if n_docs:
            for of, name in zip(("part", "index"), names, strict=True):
                fs.move(f"{root}/{name}", f"{root}/{of}-{part:05d}.arrow")
            yield pa.record_batch([pa.array([part]), pa.array([n_docs]), pa.array([sequences.total])], names=["part", "n_docs", "n_ids"])
        else:
            for name in names:
                fs.delete_file(f"{root}/{name}")

    # the bounds of the ranges are sampled from the ids; what follows the shuffle is encoded and written once
    dealt = keyed_texts(docs).repartitionByRange(partitions(spark), "k").sortWithinPartitions("k")
    dealt.mapInArrow(write, "part long, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _bounded(index: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of an index that stand for about ``most`` ids at once, besides a longer single document."""
    stops, start = np.cumsum(index.column(2).to_numpy()), 0
    while start < index.num_rows:
        before = stops[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(stops, before + most, side="right")))
        yield index.slice(start, stop - start)
        start = stop


def _files(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the files in order, and the ids before each; one row a file."""
    files, starts, total = [], [], 0
    for row in sorted(spark.read.parquet(f"{path}/manifest").collect()):
        files.append(row["part"])
        starts.append(total)
        total += row["n_ids"]
    return files, starts


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, read from the files of a store.

    ``start`` counts the ids of all documents before it; the crc is of the ids as little-endian unsigned 32-bit
    integers.
    """
    files, starts = _files(spark, path)
    names = ["k", "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, root = _opened(path)
                table = SequenceFile(fs, f"{root}/part-{files[i]:05d}.arrow")
                index = ipc.open_file(fs.open_input_file(f"{root}/index-{files[i]:05d}.arrow"))
                for rows in (r for b in range(index.num_record_batches) for r in _bounded(index.get_batch(b))):
                    k, at, n = (c.to_numpy() for c in rows.columns)
                    flat = table.span(int(at[0]), int(at[-1] + n[-1])).astype("<u4")
                    raw, stops = memoryview(flat).cast("B"), np.cumsum(n)
                    crcs = [crc32(raw[4 * b - 4 * m : 4 * b]) for b, m in zip(stops.tolist(), n.tolist(), strict=True)]
                    columns = [rows.column(0), pa.array(at + starts[i]), rows.column(2), pa.array(crcs, pa.int64())]
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), pa.array(flat.view("<i4")))
                    yield pa.record_batch([*columns, *[lists] * ids], names=names)

    if not files:
        frame = spark.range(0)
    else:
        frame = spark.range(0, len(files), 1, len(files))
    out = frame.mapInArrow(read, "k long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return out.select(unkey("k").alias("doc_id"), *names[1:])


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, ids, n_ids): the equal-length sequences as they lie in the files; n_ids leaves out the padding."""
    files, _ = _files(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, root = _opened(path)
                reader, row = ipc.open_file(fs.open_input_file(f"{root}/part-{files[i]:05d}.arrow")), 0
                for b in range(reader.num_record_batches):
                    some = reader.get_batch(b)
                    counts = [sum(x) for x in some.column("mask").to_pylist()]
                    ids = some.column("ids").cast(pa.list_(pa.int32()))
                    rows = pa.array(range(row, row + some.num_rows), pa.int64())
                    yield pa.record_batch([pa.array([files[i]] * some.num_rows, pa.int64()), rows, ids, pa.array(counts, pa.int64())], names=["part", "row", "ids", "n_ids"])
                    row += some.num_rows

    frame = spark.range(0, len(files), 1, max(1, len(files)))
    return frame.mapInArrow(read, "part long, row long, ids array<int>, n_ids long").select("part", "row", "ids", F.col("n_ids"))
