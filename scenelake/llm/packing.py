"""Best-fit packing of documents into sequences by minimum bin slack.

For each bin the longest piece that is left is set, and a subset-sum table, kept as a bitset over the lengths that are
left, finds the fullest feasible combination for the rest of the bin; the combination is removed and the next bin
begins. The choice depends on the counts of pieces by length alone, of which there are no more than the capacity, so
the counts are all that the driver sees; a combination is removed as often as the counts allow before the table is made
again. Pieces find their bin by their rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import bounded_batches, crc32, keyed_texts, ranked, remove, saved, slices, unkey
from scenelake.llm.encode import encoder


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how often each is taken, at most ``counts`` times, so that their sum comes closest to ``capacity``.

    Bit s of ``sums`` tells that s can be reached with the lengths seen; longer lengths come first.
    """
    full, sums, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        steps.append((length, sums))
        left, times = min(counts[length], capacity // length), 1
        while left:  # counts are split into 1, 2, 4, ... and a rest
            times = min(times, left)
            sums |= sums << (times * length) & full
            left, times = left - times, times * 2
        if sums >> capacity & 1:
            break
    rest, taken = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> rest & 1:
            taken[length] = taken.get(length, 0) + 1
            rest -= length
    return taken


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: times in each}) for all pieces; ``counts`` has the number of pieces by length."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        bins = min(left[k] // v for k, v in taken.items())
        for k, v in taken.items():
            left[k] -= bins * v
            if not left[k]:
                del left[k]
        out.append((bins, taken))
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """(k, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut where longer than a sequence.

    All pieces of a cut document but the first are as long as a sequence.
    """
    bounded_batches(docs.sparkSession)
    names = ["k", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch):
                rows = []
                bodies = [b.decode() for b in some.column(1).to_pylist()]
                for k, raw in zip(some.column(0).to_pylist(), enc.encode(bodies), strict=True):
                    raw += end
                    n = len(raw) // 4
                    stops = range(n % capacity or min(n, capacity), n + 1, capacity)
                    for i, stop in enumerate(stops):
                        start = stops[i - 1] if i else 0
                        part = raw[4 * start : 4 * stop]
                        rows.append((k, i, start, stop - start, crc32(part), *[np.frombuffer(part, "<i4")] * ids))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "k long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return keyed_texts(docs).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Places every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Nothing but a document longer than ``capacity`` is cut. A null or empty text is one piece of the end id alone; a
    null id is kept as null; rows that repeat an id are all placed. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table, path = saved(pieces(docs, tokenizer, capacity, end_id, ids), "pieces")
    narrow = table if ids else table.select("k", "piece", "start", "length", "ids_crc32")
    placed, _ = ranked(narrow, "length", "k", "piece", "start", "ids_crc32", name="pieces-ranked")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    remove(spark, path)

    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    # one entry for each pattern and length in it: from which rank on, times in a bin, the first bin, the place in a bin
    entries, used, first = [], dict.fromkeys(counts, 0), 0
    for bins, taken in patterns(counts, capacity):
        at = 0
        for length, times in sorted(taken.items(), reverse=True):
            entries.append((before[length] + used[length], times, first, at, length))
            used[length] += bins * times
            at += length * times
        first += bins
    table_of = np.array(sorted(entries) or np.zeros((0, 5)), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            start, times, base, at, length = table_of[np.searchsorted(table_of[:, 0], rank, side="right") - 1].T
            bins, nth = np.divmod(rank - start, times)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*columns, pa.array(base + bins), pa.array(at + nth * length)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in placed.dtypes if n != "rank")
    out = placed.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    wanted = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids]
    return out.select(unkey("k").alias("doc_id"), *[F.col(c) for c in wanted])
