"""What the corpus operators share: keys, batches, scratch tables and connected components.

Conventions that every operator of this subpackage follows:

* A null text counts as the empty text. A null id is a document of its own; it sorts before every other id.
* Ids are expected to be unique. Rows that repeat an id are all returned, and share what is decided by id.
* Only the named columns are read, so further columns cannot clash with those an operator adds.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import tempfile
import threading
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id while ids are compared and joined.
NULL_ID = -(2**63)
#: Bytes of text that Python holds at once, besides a longer single text.
SLICE_BYTES = 4 << 20


def key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID).cast("long"))


def unkey(col: Column | str) -> Column:
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID).cast("long"))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, body): the id with nulls replaced, and the text as UTF-8 bytes."""
    return docs.select(key(id_col).alias("k"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def text_hash(text_col: str = "text") -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def hashed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, text_hash, body)."""
    return docs.select(key(id_col).alias("k"), text_hash(text_col).alias("text_hash"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch where the session sets no bound, as a row count does not bound memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) >= 2**31 - 2**20:
        spark.conf.set(name, str(most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where none is set and all
    run in one process. On a cluster without that setting there is no such folder, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base


_SCOPES = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_SCOPES, "open", []):
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the scratch tables that operators of this thread have made within it.

    Results are read from such tables, so they must have been written, or otherwise used up, before the end.
    """
    made: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", []), made]
    try:
        yield made
    finally:
        _SCOPES.open = [x for x in _SCOPES.open if x is not made]
        remove(spark, *made)


def saved(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it back, so that a lost executor costs only what follows.

    The shuffle files of this one write are released when it ends; the session's own setting is put back.
    """
    spark = df.sparkSession
    path, setting = scratch_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no returned DataFrame reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: str = "body", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes of one column each."""
    ends = np.cumsum([len(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_rows(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


#: Rows of a key that one task may always hold.
TASK_ROWS = 64


def hot_keys(df: DataFrame, key: str, count: str) -> list:
    """Keys with more rows, by ``count``, than a quarter of what a task holds on average; df has one row a key.

    They are at most four times the tasks of a shuffle. Keys of at most TASK_ROWS rows are never among them.
    """
    total = df.agg(F.sum(count)).first()[0] or 0
    least = max(TASK_ROWS, total // (4 * partitions(df.sparkSession)))
    return [r[0] for r in df.where(F.col(count) > least).select(key).collect()]


#: Tasks over which the rows of a frequent key are spread.
SALTS = 256


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """left join right on ``key``, of which ``right`` has one row each and ``left`` has no nulls.

    Keys that hold more than a fair share of a task (hot_keys) are at most four times the tasks. Their left rows are
    dealt to SALTS groups by a hash of the whole row, and their right rows are repeated for each, so no key brings all
    its rows to one task. ``hot`` names those keys where they are known.
    """
    hot = hot_keys(left.groupBy(key).count(), key, "count") if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    spark, salt, flag = left.sparkSession, f"_salt_{key}", f"_hot_{key}"
    keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], left.select(key).schema).withColumn(flag, F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS))
    left = left.join(keys, key, "left").withColumn(salt, F.when(F.col(flag), spread).otherwise(0)).drop(flag)
    every = F.when(F.col(flag), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = right.join(keys, key, "left").withColumn(salt, F.explode(every)).drop(flag)
    return left.join(right, [key, salt], how).drop(salt)


# --- arrays in files that workers map ------------------------------------------------------------------------------


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, of a URI or a plain local path; local files are mapped."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return (pafs.LocalFileSystem(use_mmap=True), path) if isinstance(fs, pafs.LocalFileSystem) else (fs, path)


def write_arrays(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays of one dimension side by side in one file; a task that runs again leaves the same file."""
    fs, root = opened(uri)
    fs.create_dir(root, recursive=True)
    head, at = {}, 0
    for n, a in arrays.items():
        head[n] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    own = f"{root}/_{name}-{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        out.write((f"{len(text):015d}\n".encode() + text).ljust(-(-(16 + len(text)) // 64) * 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    fs.move(own, f"{root}/{name}")


def mapped_arrays(uri: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped and so shared by the workers of a machine; None where there is no such file.

    A file of a store that is not mounted is read into memory.
    """
    fs, root = opened(uri)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as source:
            raw = np.frombuffer(source.read_buffer(), np.uint8)
    size = int(bytes(raw[:15]))
    start = -(-(16 + size) // 64) * 64
    head = json.loads(bytes(raw[16 : 16 + size]))
    return {n: raw[start + at : start + at + np.dtype(kind).itemsize * k].view(kind) for n, (kind, k, at) in head.items()}


class Mapped(dict):
    """The arrays of numbered files by their number, empty where there is no file.

    At most ``files`` are open at once, below what a process may map, and of those that are read into memory at most
    ``most`` bytes; those opened first are let go.
    """

    def __init__(self, uri: str, name: str, files: int = 8192, most: int = 256 << 20):
        super().__init__()
        self.uri, self.name, self.files, self.most, self.held = uri, name, files, most, 0

    def __missing__(self, number: int) -> dict[str, np.ndarray]:
        found = mapped_arrays(self.uri, self.name.format(number)) or {}
        self.held += self._bytes(found)
        while self and (len(self) >= self.files or self.held > self.most):
            self.held -= self._bytes(self.pop(next(iter(self))))
        self[number] = found
        return found

    @staticmethod
    def _bytes(found: dict[str, np.ndarray]) -> int:
        return sum(0 if isinstance(a, np.memmap) else a.nbytes for a in found.values())


# --- hashing of words ---------------------------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all at ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of every ``width`` consecutive values, by doubling; none where there are fewer values."""
    if len(h) < width:
        return h[:0]
    have, n, out, done = 1, len(h), None, 0
    while True:
        if width & have:
            shifted = h[done:]
            out = h if out is None else out[: len(shifted)] * np.uint64(pow(base, have, 1 << 64)) + shifted[: len(out)]
            done += have
            if done == width:
                return out[: n - width + 1]
        h = h[:-have] * np.uint64(pow(base, have, 1 << 64)) + h[have:]
        have *= 2


def stable_order(h: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit numbers: their leading bits and their places are sorted as one number.

    Where numbers differ in trailing bits only, which is rare for hashes, they are sorted in full.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    bits = np.uint64(len(h).bit_length())
    packed = h << np.uint64(64 - max(1, int(h.max()).bit_length())) >> bits << bits | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    in_order = h[order]
    return order if (in_order[1:] >= in_order[:-1]).all() else np.argsort(h, kind="stable")


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# --- connected components -----------------------------------------------------------------------------------------


#: Edges among which a task finds what hangs together before the shuffle.
FOREST_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest that hangs together with it, among every FOREST_EDGES edges of a task."""

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
        hung = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[hung]]), pa.array(nodes[hung])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= FOREST_EDGES:
            yield settled(held)
            held = []
    if held:
        yield settled(held)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node reachable.

    Tasks first hang what their own edges join on its smallest node, which shortens long paths. Each round then hooks
    every node to the smallest label among its neighbours and follows labels twice; each round is written to the shared
    folder. The rows per round stay below those of the edges; nothing reaches the driver but whether a label changed
    and which labels stand for more nodes than a quarter of a task's share. Joins by such a label are spread over many tasks.
    Edges to the node itself or with nulls say nothing. Raises if ``rounds`` are not enough (labels settle in about
    the logarithm of the longest path).
    """
    spark = edges.sparkSession
    hung = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long")
    both = hung.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()
    both, kept = saved(both, f"{name}-edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels, path = saved(first.select("node", F.least("low", "node").alias("root"), F.lit(True).alias("changed")), name)
    for _ in range(rounds):
        counts = labels.groupBy("root").agg(F.count("*").alias("n"), F.bool_or("changed").alias("changed"))
        total = counts.agg(F.sum("n"), F.bool_or("changed"), F.max("n")).first()
        if not total[1]:
            remove(spark, kept)
            return labels.select("node", "root"), path
        least = max(TASK_ROWS, total[0] // (4 * partitions(spark)))
        hot = [r[0] for r in counts.where(F.col("n") > least).select("root").collect()] if total[2] > least else []
        # the smallest label next to each node, given also to the node's present root
        near = attach(both, labels.select(F.col("node").alias("b"), "root"), "b", hot=hot).groupBy("a").agg(F.min("root").alias("low"))
        hooked = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "low").alias("low"))
        parents = hooked.select(F.col("node").alias("n"), "low").union(hooked.select(F.col("root"), F.col("low")))
        parents = parents.groupBy("n").agg(F.min("low").alias("up"))
        moved = labels.join(parents, labels.node == parents.n).select("node", F.col("root").alias("old"), "up")
        new = attach(moved, parents.select(F.col("n").alias("up"), F.col("up").alias("up2")), "up", "left", hot=hot)
        new = new.select("node", F.least("up", "up2").alias("root"), (F.col("old") != F.least("up", "up2")).alias("changed"))
        new, next_path = saved(new, name)
        remove(spark, path)
        labels, path = new, next_path
    raise RuntimeError("the components did not settle")


# --- global ranks -------------------------------------------------------------------------------------------------


def ranked(df: DataFrame, *order: str, name: str = "ranked") -> tuple[DataFrame, str]:
    """Adds ``rank`` (from 0, without gaps) by the order of all rows, written to the shared folder.

    Rows are dealt by ranges and sorted within them; only one count for each range reaches the driver. ``order`` must
    tell all rows apart, or equal rows get their ranks in any order.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    table, path = saved(dealt, name)
    starts, total = [], 0
    for row in sorted(table.groupBy("_part").count().collect()):
        starts.append((row["_part"], total))
        total += row["count"]
    starts = spark.createDataFrame(starts, "_part long, _start long")
    out = table.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_place"))
    return out.drop("_part", "_place", "_start"), path
