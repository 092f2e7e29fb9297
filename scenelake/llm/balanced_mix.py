"""Mixing sources to target weights: balanced sampling of documents by the cube method.

Each source's documents are taken target / size times. The whole part of that is the same for all; whether a document is
taken once more is drawn so that, source by source, the words and the number of documents stay what they are expected to
be. The flight moves three fractional inclusion probabilities at a time along the one direction that changes neither
(the null space of the two constraints) until one of them is 0 or 1; the few that are left in the end are landed by
the best of their combinations. Flights run side by side on groups of a bounded number of documents, and what they
leave, two documents each at most, is gathered into groups again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import attach, key, mixed, ranked, saved, unkey

#: Documents of one flight.
GROUP = 4096
#: Documents of a source that are kept for the landing, besides the two that a flight leaves.
LAND = 14
#: Weights of the sources in their order, repeating, and the most that a source is repeated.
WEIGHTS, MOST = (5, 2, 1), 3

WORD = r"[^\x20\x09-\x0D]+"


def flight(size: np.ndarray, p: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1, and their sum and that of p * size are as before.

    Three at a time take a step, the largest sizes first, so that what is left tends to be small.
    """
    p, turn = p.astype(float), 0
    while True:
        active = np.flatnonzero((p > 0) & (p < 1))
        if len(active) < 3:
            return p
        active = active[np.argsort(-size[active], kind="stable")]
        three = active[: len(active) // 3 * 3].reshape(-1, 3)
        x, q = size[three].astype(float), p[three]
        u = np.roll(x, -1, 1) - np.roll(x, -2, 1)  # x2 - x3, x3 - x1, x1 - x2: neither the sum nor that of sizes changes
        u[(u == 0).all(1)] = (1, -1, 0)
        u /= np.abs(u).max(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            room_up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))
            room_down = np.where(u > 0, q / u, np.where(u < 0, -(1 - q) / u, np.inf))
        up, down = room_up.min(1), room_down.min(1)
        draw = (mixed(seeds[three[:, 0]] + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53
        rises = draw * (up + down) < down
        q = np.clip(q + np.where(rises, up, -down)[:, None] * u, 0, 1)
        q[q < 1e-12], q[q > 1 - 1e-12] = 0, 1
        # the probability that ends the step is put on its bound exactly
        row, at = np.arange(len(u)), np.where(rises, room_up.argmin(1), room_down.argmin(1))
        q[row, at] = np.where(rises == (u[row, at] > 0), 1.0, 0.0)
        p[three] = q
        turn += 1


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the probabilities that are left, 16 at most, by the combination that changes words least; a number of
    documents that is off by more than one counts like a mean document each."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    if len(left) > 16:
        raise ValueError("the flight has left too many")
    bits = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    words = np.abs(bits @ size[left] - p[left] @ size[left])
    count = np.maximum(np.abs(bits.sum(1) - p[left].sum()) - 1, 0)
    p = p.copy()
    p[left] = bits[np.argmin(words + count * (size[left].mean() + 1))]
    return p


def settled(size: np.ndarray, p: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Flight and landing of all that is left of a source; some documents of all sizes are kept for the landing."""
    active = np.flatnonzero((p > 0) & (p < 1))
    if len(active) <= LAND + 2:
        return landing(size, p)
    rest = np.ones(len(p), bool)
    by_size = active[np.argsort(size[active], kind="stable")]
    rest[by_size[np.linspace(0, len(by_size) - 1, min(LAND, len(by_size) // 2)).astype(int)]] = False
    p = p.astype(float)
    p[rest] = flight(size[rest], p[rest], seeds[rest])
    return landing(size, p)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """s, source_size, target of each source: shares of all sizes by weight, none above ``most`` times its own size.

    What a capped source leaves is shared by the others by weight, until none is above. ``sizes`` has s (a text that
    tells sources apart, also the null one) and source, in whose order, null last, the weights repeat. A few sums over
    one row a source reach the driver in each round.
    """
    totals = sizes.groupBy("s", "source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    totals, _ = ranked(totals, "last", "source", name="sources")
    totals = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    capped = lambda share: F.col("w") * share > most * F.col("source_size")
    share, before = 0.0, -1
    while True:
        over = capped(F.lit(share))
        full, inside, free, n = totals.agg(F.sum("source_size"), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("w"))), F.count_if(over)).first()
        if not full or n == before or not free:
            break
        share, before = (full - most * (inside or 0)) / free, n
    target = F.least(F.col("w") * share, most * F.col("source_size").cast("double"))
    return totals.select("s", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _flown(rows: DataFrame, by: list[str], last: bool) -> DataFrame:
    """Rows with ``p`` after the flight of each group, and after the landing if it is the last."""

    def fly(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        size, p, seeds = table["size"].to_numpy(), table["p"].to_numpy(), table["h"].to_numpy().view(np.uint64)
        p = settled(size, p, seeds) if last else flight(size, p, seeds)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return rows.groupBy(*by).applyInArrow(fly, rows.schema)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42, group: int = GROUP) -> DataFrame:
    """doc_id, size, source_size, target and copies (how often the mix takes the document) of every document.

    Sizes are words; null texts have none. Draws follow from ids, texts and ``seed`` alone, in an order of all
    documents, so reruns agree on any cluster. Rows that agree in id, text and source may be taken differently, but as
    often together in every run. A source without words has the target 0; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    rows = docs.select(
        key().alias("k"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("s"), source.alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), key(), text).alias("h"),
    )
    rows, _ = saved(rows, "sizes")
    targets, _ = saved(source_targets(rows, weights, most), "targets")
    # one more for what is within rounding of a whole number of copies
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(ratio + 1e-9).cast("long")
    part = ratio - whole
    rows = attach(rows.drop("source"), targets, "s").withColumns({"whole": whole, "p": F.when(part > 1e-9, part).otherwise(0.0)})
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    open_, _ = ranked(rows, "s", "h", "k", "size", "tie", name="mix")
    open_ = open_.drop("tie")
    columns = open_.columns
    done = open_.where("p = 0")
    open_ = open_.where("p > 0")
    while (open_.groupBy("s").count().agg(F.max("count")).first()[0] or 0) > group:
        table, _ = saved(_flown(open_.withColumn("g", F.floor(F.col("rank") / group)), ["s", "g"], False).drop("g"), "flight")
        done = done.unionByName(table.where("p = 0 OR p = 1"))
        open_, _ = ranked(table.where("p > 0 AND p < 1").drop("rank"), "s", "h", "k", "size", name="flight")
    done = done.unionByName(_flown(open_.select(*columns), ["s"], True))
    return done.select(unkey("k").alias("doc_id"), "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """copies() with the words that the mix takes of each document, repeats counted, as ``taken``."""
    found = copies(docs, weights, most, seed)
    return found.withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "size", "source_size", "target", "taken", "copies")
