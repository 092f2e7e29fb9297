"""Shards cut from a Hilbert curve over several metadata columns, so that files can be pruned by any of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import attach, fresh, hot_keys, key, ranked, remove, saved, unkey


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of cells (rows) with ``bits`` bits in each of their columns.

    Skilling's transform (AIP Conf. Proc. 707, 2004) on whole columns.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | x[i] >> b & 1
    return index


def with_ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the place of a text among the distinct values of its column, in their order; nulls count as "".

    Values are ranked by a distributed sort and joined back by value, frequent values spread over tasks.
    """
    (value,) = fresh(df, f"_{name}")
    df = df.withColumn(value, F.coalesce(F.col(column).cast("string"), F.lit("")))
    places, _ = ranked(df.select(value).distinct(), value, name="values")
    return attach(df, places.withColumnRenamed("rank", name), value).drop(value)


def hilbert_order(df: DataFrame, dimensions: dict[str, Column], bits: int = 7) -> DataFrame:
    """Adds ``hilbert``: the place on the curve after cutting each dimension at its quantiles into 2**bits cells.

    Quantiles come from Spark's mergeable approximate percentiles over all rows. A null dimension is in the first cell.
    A column of that name in the input is replaced.
    """
    columns = [f"_dimension{i}_{uuid.uuid4().hex}" for i in range(len(dimensions))]
    df = df.drop("hilbert")
    wide = df.withColumns({n: c.cast("double") for n, c in zip(columns, dimensions.values(), strict=True)})
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = wide.agg(*[F.percentile_approx(c, parts, 10_000).alias(c) for c in columns]).first()
    cuts = [np.unique(np.array(found[c] if found[c] is not None else [], float)) for c in columns]
    kept = [c for c in wide.columns if c not in columns]
    kinds = ", ".join(f"`{n}` {t}" for n, t in wide.dtypes if n in kept)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns]
            cells = [np.where(np.isnan(v), 0, np.searchsorted(q, v, side="left")) for v, q in zip(values, cuts, strict=True)]
            place = hilbert_index(np.stack(cells, 1), bits) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(place)], names=[*kept, "hilbert"])

    return wide.mapInArrow(index, f"{kinds}, hilbert long")


def cuts_of(n: int, shards: int, inside: Callable[[list[int]], set[int]], slack: int = 8) -> list[int]:
    """First ranks of the shards after the first, all shards having n // shards or one more.

    Which shards have one more is free: of the choices that stay within ``slack`` of an even spread, the one with the
    fewest cuts inside a group is taken. ``inside`` tells which of some ranks are inside a group.
    """
    base, extra = divmod(n, shards)
    able = [[e for e in range(max(0, i * extra // shards - slack, extra - (shards - i)), min(i, extra, i * extra // shards + slack) + 1)] for i in range(shards + 1)]
    bad = inside(sorted({i * base + e for i in range(1, shards) for e in able[i] if 0 < i * base + e < n}))
    best = {0: (0, [])}
    for i in range(1, shards + 1):
        new = {}
        for e in able[i]:
            options = [best[p] for p in (e - 1, e) if p in best]
            if options:
                cost, path = min(options)
                new[e] = (cost + (i < shards and i * base + e in bad), [*path, i * base + e])
        best = new
    return best[extra][1][:-1]


def _placed(docs: DataFrame, shards: int, bits: int) -> DataFrame:
    """k, size, text_crc32, copy_of, shard, slot of every row."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        key().alias("k"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).substr(1, 32).alias("copy_of"), "lang", "source",
    )
    rows, rows_path = saved(rows, "shard-rows")  # the texts are read and hashed once
    # one row a group: the partial aggregate keeps a hot text to one row for each task
    groups = rows.groupBy("copy_of").agg(F.min(F.struct("k", "lang", "source", "size")).alias("first"), F.count("*").alias("copies"))
    groups = groups.select("copy_of", "copies", F.col("first.k").alias("first_k"), *[F.col(f"first.{c}").alias(c) for c in ("lang", "source", "size")])
    groups, groups_path = saved(with_ordinal(with_ordinal(groups, "lang", "lang_no"), "source", "source_no").drop("lang", "source"), "groups")
    groups = hilbert_order(groups, {"lang": F.col("lang_no"), "source": F.col("source_no"), "size": F.col("size")}, bits)
    hot = hot_keys(groups, "copy_of", "copies")
    placed = attach(rows.select("k", "size", "text_crc32", "copy_of"), groups.select("copy_of", "hilbert", "first_k"), "copy_of", hot=hot)
    table, _ = ranked(placed, "hilbert", "first_k", "copy_of", "k", "size", "text_crc32", name="hilbert")
    remove(docs.sparkSession, groups_path, rows_path)

    def inside(ranks: list[int]) -> set[int]:
        wanted = {x for r in ranks for x in (r - 1, r)}  # about 40 for each shard
        copy_of = {r["rank"]: r["copy_of"] for r in table.where(F.col("rank").isin(list(wanted))).select("rank", "copy_of").collect()} if wanted else {}
        return {r for r in ranks if copy_of[r - 1] == copy_of[r]}

    starts = [0, *cuts_of(table.count(), shards, inside)]
    shard = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda x: x <= F.col("rank"))) - 1
    table = table.withColumn("shard", shard)
    return table.withColumn("slot", F.col("rank") - F.array(*[F.lit(x).cast("long") for x in starts])[F.col("shard")])


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 7) -> DataFrame:
    """Cuts documents, in the order of a Hilbert curve over lang, source and size, into runs of equal count.

    Returns doc_id, size (bytes of the text plus 8), text_crc32, law ('rows'), shard, slot, grown_shard (null). Shards'
    counts differ by one at most. Rows of one text form a group that takes the place of its smallest id and stays
    together but where a cut falls within it: cuts move to a group's edge where the counts allow it, and a group that
    is larger than the one row by which they may move, or than a shard, can still be cut. Null texts are empty, null
    ids come first, repeated rows each get a slot; an empty table gives no rows.
    """
    return _placed(docs, shards, bits).select(
        unkey("k").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, bits: int = 7) -> None:
    """Writes the documents, all columns, as one folder a shard (shard=N), each in the order of the curve.

    Files so hold narrow ranges of lang, source and size, and readers skip those whose statistics exclude a filter.
    Rows that agree in id and text share a place. A column called shard is replaced.
    """
    docs = docs.drop("shard")
    k, copy, slot = fresh(docs.withColumn("shard", F.lit(0)), "_k", "_copy", "_slot")
    placed = _placed(docs, shards, bits).groupBy(F.col("k").alias(k), F.col("copy_of").alias(copy)).agg(F.min(F.struct("shard", "slot")).alias("place"))
    placed = placed.select(k, copy, F.col("place.shard").alias("shard"), F.col("place.slot").alias(slot))
    text = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).substr(1, 32)
    rows = docs.withColumns({k: key(), copy: text}).join(placed, [k, copy])
    rows.repartition(shards, "shard").sortWithinPartitions("shard", slot).drop(k, copy, slot).write.partitionBy("shard").parquet(path)
