"""Near-duplicate vectors by lattice hashing: random projections decoded to points of E8, in several tables.

A table projects unit vectors to one or more blocks of eight dimensions and decodes each block to the nearest point of
the lattice E8; the points together are the cell. A vector goes to its own cell and, as probes, to the cells that differ
by a step to a nearest neighbouring point in one block; two vectors meet in a cell that is the own cell of at least one.
All that meet are verified by cosine in double precision.

The more vectors there are, the more blocks make up a cell, so that a vector meets about as many strangers at any size;
as many tables are made as a cosine of 0.95 needs to be missed by all of them once in ten thousand times.

Equal vectors are one class from the start. First only ids go to cells; cells where nobody meets, nearly all, end there,
and vectors follow to the others. No pair leaves a task: a cell's tasks count the links of each vector and join it to
the first vector of its part of the cell. A pair that meets more than once counts in the first table and cell alone,
which every task can tell from the cells of both. Cells of over ``BLOCK`` rows are cut into blocks, and each pair of
blocks is a task's work of its own.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import attach, bounded_batches, components, hot_keys, key, mixed, remove, saved, unkey

PROBES, SCALE, BLOCK = 2, 4.5, 1500
#: Cells of up to SMALL rows are compared together, POOL rows of them at a time.
SMALL, POOL = 64, 8_000
#: Chances, at these settings and a cosine of 0.95, that a block has the same point, and that only a probe finds it
#: (measured on random pairs); and of how many more vectors another block makes up for.
_SAME, _PROBED, _PER_BLOCK = 0.375, 0.41, 150
#: Up to so many vectors one block is enough: each then meets some seventy strangers, as it does at any size.
ONE_BLOCK = 2_000


def plan(n: int, missed: float = 1e-4) -> tuple[int, int]:
    """(tables, blocks) for n vectors."""
    blocks = 1 + max(0, math.floor(math.log(max(1, n / ONE_BLOCK), _PER_BLOCK) + (n > ONE_BLOCK)))
    meet = _SAME**blocks + blocks * _SAME ** (blocks - 1) * _PROBED
    return math.ceil(math.log(missed) / math.log(1 - meet)), blocks


@functools.cache
def _roots() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    ints = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array([*ints, *halves], float)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: integers of even sum, or these shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@functools.lru_cache(maxsize=16)
def _frames(d: int, n: int, scale: float, seed: int) -> list[np.ndarray]:
    """n projections of d dimensions to eight."""
    rng = np.random.default_rng([seed, d])
    return [np.linalg.qr(rng.normal(size=(max(d, 8), 8)))[0][:d] * scale * np.sqrt(max(d, 8) / 64) for _ in range(n)]


def cells(vectors: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int = 5) -> np.ndarray:
    """(rows, tables, 1 + blocks * probes) hashes of each row's own cell and of the neighbouring ones it probes."""
    n, d = vectors.shape
    roots, frames = _roots(), _frames(d, tables * blocks, scale, seed)
    lengths = (roots**2).sum(1)
    out = np.empty((n, tables, 1 + blocks * probes), np.int64)

    def hashed(points: np.ndarray, place: int) -> np.ndarray:
        h = np.full(n, place, np.uint64)
        for c in range(8):
            h = mixed(h * np.uint64(3) + np.rint(2 * points[:, c]).astype(np.int64).view(np.uint64))
        return h

    for t in range(tables):
        own, near = [], []
        for b in range(blocks):
            x = vectors @ frames[t * blocks + b]
            point = decode(x)
            far = lengths - 2 * (x - point) @ roots.T  # squared distance to point + root, less what is the same for all
            own.append(hashed(point, t * blocks + b + 1))
            for _ in range(probes):
                least = far.argmin(1)
                far[np.arange(n), least] = np.inf
                near.append((b, hashed(point + roots[least], t * blocks + b + 1)))
        total = np.sum(own, axis=0, dtype=np.uint64)
        out[:, t, 0] = mixed(total).view(np.int64)
        for i, (b, h) in enumerate(near, 1):
            out[:, t, i] = mixed(total - own[b] + h).view(np.int64)
    return out


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of (tables, 1 + probes) rows meet, by table."""
    return (a[:, :, 0] == b[:, :, 0]) | (a[:, :, :1] == b[:, :, 1:]).any(2) | (b[:, :, :1] == a[:, :, 1:]).any(2)


def _close(x: np.ndarray, owns: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that reach the cosine, of which one owns the cell.

    ``side``: 0 both, 1 first block, 2 second block; rows of two blocks are compared across only.
    """
    left, right = [], []
    for i in range(0, len(x), 512):
        a, b = np.nonzero(x[i : i + 512] @ x[i:].T >= least)
        a, b = a + i, b + i
        ok = (a < b) & (owns[a] | owns[b]) & ((side[a] == 0) | (side[a] != side[b]))
        left.append(a[ok])
        right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def _close_in_small(x: np.ndarray, owns: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for the rows of many small cells, each cell's rows together and under a number of its own."""
    left, right = [], []
    for step in range(1, len(x)):
        a = np.flatnonzero(unit[:-step] == unit[step:])
        if not len(a):
            break
        a = a[owns[a] | owns[a + step]]
        a = a[np.einsum("ij,ij->i", x[a], x[a + step]) >= least]
        left.append(a)
        right.append(a + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _first_meetings(a: np.ndarray, b: np.ndarray, x: np.ndarray, table: np.ndarray, cell: np.ndarray, cells_of) -> np.ndarray:
    """Which pairs meet in the row's table and cell before any other; ``cells_of`` gives the cells of vectors."""
    keep = np.ones(len(a), bool)
    for s in range(0, len(a), 50_000):
        i, j = a[s : s + 50_000], b[s : s + 50_000]
        some, number = np.unique(np.r_[i, j], return_inverse=True)
        at = cells_of(x[some])
        p, q, t = at[number[: len(i)]], at[number[len(i) :]], table[i]
        before = (_met(p, q) & (np.arange(at.shape[1]) < t[:, None])).any(1)
        first, second = p[np.arange(len(i)), t], q[np.arange(len(i)), t]
        here = np.where(  # where they meet in this table: at the first's own cell, the second's, or either
            (first[:, :1] == second).any(1), np.where((second[:, :1] == first).any(1), np.minimum(first[:, 0], second[:, 0]), first[:, 0]), second[:, 0]
        )
        keep[s : s + 50_000] = ~before & (here == cell[i])
    return keep


def _unit_rows(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the lists of each length."""
    sizes = np.diff(v.offsets.to_numpy())
    flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
    for d in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == d)
        x = flat[starts[pick][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield pick, x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, least: float = 0.95, tables: int | None = None, blocks: int | None = None, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, embedding).

    Links are pairs of cosine ``least`` or more in double precision. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Equal vectors link with each other
    and share the links of their class. A null id counts as the smallest; every row is returned, rows that repeat an id
    too, and an empty table gives none. ``tables`` and ``blocks`` follow from the number of vectors if not given.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(key("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    good = rows.where("v is not null").withColumn("code", F.concat_ws(" ", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    # a class goes by its number, as different vectors may share an id; 128 bits stand for its numbers
    classes = good.groupBy("code").agg(F.min("k").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes, classes_path = saved(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")
    planned = plan(classes.count())
    tables, blocks = tables or planned[0], blocks or planned[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = 1 + blocks * probes
        for batch in batches:
            c = batch.column(0).to_numpy()
            for pick, x in _unit_rows(batch.column(1)):
                for s in range(0, len(pick), 500):
                    found = cells(x[s : s + 500], tables, blocks, probes, scale)
                    n = len(found) * tables * many
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(tables), many), len(found)), pa.int32()),
                        pa.array(np.arange(n) % many == 0), pa.array(np.repeat(c[pick[s : s + 500]], tables * many)),
                    ], names=["cell", "t", "owns", "c"])

    placed = classes.select("c", "v").mapInArrow(place, "cell long, t int, owns boolean, c long")
    # cells where nobody meets are left out; large ones are dealt as pairs of blocks
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.bool_or("owns").alias("any_own")).where("rows > 1 and any_own")
    sizes, sizes_path = saved(sizes.select("cell", "rows", F.expr(f"(rows + {BLOCK - 1}) div {BLOCK}").alias("cuts")), "vector-cells")
    met = attach(placed, sizes.select("cell", "cuts"), "cell", hot=hot_keys(sizes, "cell", "rows"))
    dealt = met.join(classes.select("c", "n", "v"), "c").withColumn("block", F.expr("pmod(xxhash64(c), cuts)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, cuts - 1)"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.withColumn("side", F.expr("case when low = high then 0 when block = low then 1 else 2 end"))
    dealt = dealt.select("cell", "low", "high", "t", "side", "owns", "c", "n", "v").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(units: list[list[pa.RecordBatch]], small: bool) -> pa.RecordBatch | None:
            rows = pa.Table.from_batches([h for held in units for h in held]).combine_chunks()
            unit = np.repeat(np.arange(len(units)), [sum(h.num_rows for h in held) for held in units])
            cell, t, side, owns, c, n = (rows.column(x).to_numpy() for x in ("cell", "t", "side", "owns", "c", "n"))
            links, roots = np.zeros(len(c), np.int64), c.copy()
            for pick, x in _unit_rows(rows.column("v").chunk(0)):
                a, b = _close_in_small(x, owns[pick], unit[pick], least) if small else _close(x, owns[pick], side[pick], least)
                if len(a):
                    ok = _first_meetings(a, b, x, t[pick], cell[pick], lambda some: cells(some, tables, blocks, probes, scale))
                    a, b = pick[a[ok]], pick[b[ok]]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                while len(a):  # the first class along the links of this task
                    low = np.minimum(roots[a], roots[b])
                    new = roots.copy()
                    np.minimum.at(new, a, low)
                    np.minimum.at(new, b, low)
                    if (new == roots).all():
                        break
                    roots = new
            hit = links > 0
            return pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(links[hit]), pa.array(roots[hit])], names=["c", "links", "root"]) if hit.any() else None

        held: list[pa.RecordBatch] = []  # rows of the cell that is being read
        pool: list[list[pa.RecordBatch]] = []  # small cells
        last, pooled = None, 0
        for batch in itertools.chain(batches, [None]):
            group = np.zeros((1, 3), np.int64) if batch is None else np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if batch is None or last != (now := tuple(group[a].tolist())):
                    rows = sum(h.num_rows for h in held)
                    if held and rows <= SMALL and last[1] == last[2]:  # a part of a large cell that meets itself will do as well
                        pool.append(held)
                        pooled += rows
                    elif held and (out := count([held], False)) is not None:
                        yield out
                    held = []
                    if pool and (batch is None or pooled >= POOL):
                        if (out := count(pool, True)) is not None:
                            yield out
                        pool, pooled = [], 0
                    if batch is None:
                        break
                    last = now
                held.append(batch.slice(a, b - a))

    links, links_path = saved(dealt.mapInArrow(compare, "c long, links long, root long"), "vector-links")
    labels, labels_path = components(links.select(F.col("c").alias("a"), F.col("root").alias("b")), "vector-components")
    members = labels.join(classes.select("c", "rep"), F.col("node") == F.col("c")).select("c", "rep", "root")
    smallest = members.groupBy("root").agg(F.min("rep").alias("component"))
    members = attach(members.select("c", "root"), smallest, "root").select("c", "component")
    counts = links.groupBy("c").agg(F.sum("links").alias("links"))
    found = classes.select("code", "c", "n", "rep").join(counts, "c", "left").join(members, "c", "left")
    found = found.select("code", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    found, _ = saved(found, "vector-classes")
    remove(spark, classes_path, sizes_path, links_path, labels_path)
    out = attach(good.select("k", "code"), found.drop("n"), "code", hot=hot_keys(found, "code", "n")).select("k", "n_links", "root")
    out = out.unionByName(rows.where("v is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("root")))
    return out.select(unkey("k").alias("vec_id"), "n_links", unkey("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))
