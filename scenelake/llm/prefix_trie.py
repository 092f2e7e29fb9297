"""The trie of conversation prefixes, aggregated by ROLLUP over positional turn columns.

A turn is 20 bytes: the digest of role and text, and its number of words. A conversation is cut into blocks of WIDTH
turns, each a row of WIDTH turn columns keyed by the node at which the block before ends. GROUP BY block and node,
ROLLUP over the turn columns, then aggregates every prefix of every block at once: a grouping set is a depth.
The key of a node is the exclusive or of 128-bit hashes of its turns with their places, so that keys of blocks are
running sums, and no round of jobs for each block is needed. No step brings a conversation, or the members of a node,
together: turns are numbered by a sort over ranges, blocks are bounded, and members are counts and sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import NULL_ID, arrow_rows, attach, key, partitions, saved, unkey

#: Turn columns of a block.
WIDTH = 8
#: Blocks of a conversation over which one window runs.
LONG = 1024
#: Ids in a piece of a list of members.
PIECE = 1000
#: Conversations of a run of this many ids share the first turns of its first one; below 4 of them.
RUN, HEADS = 20, 4

WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, pos (from 0), t (20 bytes) of every turn, by conversation in the order of turns (null first).

    Turns that tie are ordered by role and digest. Rows are dealt by ranges of this order, which may cut a conversation
    anywhere; each task counts within its range, and what earlier ranges hold of a conversation is added: one row for
    each range at most.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0"))
    rows = conversations.select(key("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.concat(digest, words).alias("t"))
    rows, _ = saved(rows, "turns")
    order = ["c", "turn", "role", "t", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            start = first.copy()
            if c[0] == last:
                start[0] = -n
            place = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[first, len(c)]))
            last, n = c[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place)], names=["c", "t", "place"])

    counted = rows.select("c", "t").mapInArrow(count, "c long, t binary, place long")
    counted, _ = saved(counted.withColumn("range", F.spark_partition_id()), "numbered-turns")
    before = F.sum("n").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = counted.groupBy("c", "range").agg(F.count("*").alias("n")).select("c", "range", before.alias("before")).where("before is not null")
    return counted.join(F.broadcast(held), ["c", "range"], "left").select("c", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "t")


def shared_heads(turns: DataFrame) -> DataFrame:
    """c, pos, t with the first h turns of every conversation c taken from conversation c - c % RUN.

    h is crc32 of the decimal id, modulo HEADS. Where that conversation is absent or shorter, there are as many as it
    has; the conversation's own turns after its first h follow. A null id has h = 0. Every conversation, also one that
    is left without turns, has one row more, with nulls for pos and t.
    """
    h = (F.crc32(F.coalesce(unkey("c").cast("string"), F.lit("")).cast("binary")) % HEADS).alias("h")
    convs = turns.where("pos = 0").select("c", h, (F.col("c") - F.col("c") % RUN).alias("first"))
    given = turns.where((F.col("c") % RUN == 0) & (F.col("pos") < HEADS - 1)).select(F.col("c").alias("first"), "pos", "t")
    heads = convs.join(given, "first").where("pos < h").select("c", "pos", "t")
    short = convs.where("h > 0").join(heads.groupBy("c").agg(F.count("*").alias("n")), "c", "left").select("c", (F.col("h") - F.coalesce("n", F.lit(0))).alias("less")).where("less > 0")
    own = attach(turns.where(F.col("pos") >= h), short, "c", "left").select("c", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "t")
    return heads.union(own).union(convs.select("c", F.lit(None).cast("long"), F.lit(None).cast("binary")))


def _hashed(t: Column, pos: Column, half: int) -> Column:
    return F.coalesce(F.when(t.isNotNull(), F.xxhash64(F.lit(half), t, pos.cast("long"))), F.lit(0).cast("long"))


def _words(t: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(t, 17, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def _blocks(turns: DataFrame) -> DataFrame:
    """c, block, ts, len, words and the hash (x, y) of its turns; start_x, start_y and start_words: those before it."""
    pos, t = F.col("pos"), F.col("t")
    rows = turns.withColumn("block", F.coalesce(F.floor(pos / WIDTH), F.lit(0)).cast("long")).withColumn("long", F.floor(F.col("block") / LONG).cast("long"))
    ts = F.transform(F.array_sort(F.collect_list(F.when(t.isNotNull(), F.struct("pos", "t")))), lambda s: s["t"])
    made = rows.repartition("c", "long").groupBy("c", "long", "block").agg(
        ts.alias("ts"), F.count("t").alias("len"), F.sum(_words(t)).alias("words"), F.bit_xor(_hashed(t, pos, 1)).alias("x"), F.bit_xor(_hashed(t, pos, 2)).alias("y")
    )
    sums = {"x": F.bit_xor, "y": F.bit_xor, "words": F.sum}
    earlier = Window.partitionBy("c", "long").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumns({f"start_{n}": F.coalesce(f(n).over(earlier), F.lit(0)) for n, f in sums.items()})
    made, _ = saved(made, "blocks")
    # beyond LONG blocks, what the earlier runs of a conversation hold is added: one row for each run
    runs = made.join(made.where(F.col("block") == LONG).select("c"), "c", "semi").groupBy("c", "long").agg(*[f(n).alias(n) for n, f in sums.items()])
    before = Window.partitionBy("c").orderBy("long").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.select("c", "long", *[F.coalesce(f(n).over(before), F.lit(0)).alias(f"carry_{n}") for n, f in sums.items()]).where("long > 0")
    far = made.where("long > 0").join(carry, ["c", "long"])
    added = {"x": lambda a, b: a.bitwiseXOR(b), "y": lambda a, b: a.bitwiseXOR(b), "words": lambda a, b: a + b}
    far = far.withColumns({f"start_{n}": f(F.col(f"start_{n}"), F.col(f"carry_{n}")) for n, f in added.items()})
    return made.where("long = 0").unionByName(far.select(*made.columns)).drop("long")


def _rolled_up(blocks: DataFrame, values: str) -> DataFrame:
    """One row a node: node, parent (null for the root), depth, before (words above its last turn), last (its words)
    and the aggregates ``values`` over the conversations that start with it."""
    columns = [f"t{i}" for i in range(WIDTH)]
    wide = blocks.select("*", *[F.get("ts", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    depth = f"{WIDTH} - bit_count(grouping_id())"
    filled = " + ".join(f"int({c} is not null)" for c in columns)
    found = blocks.sparkSession.sql(
        f"SELECT block, start_x, start_y, start_words, {', '.join(columns)}, {depth} AS k, {values} FROM {{wide}} "
        f"GROUP BY block, start_x, start_y, start_words, ROLLUP ({', '.join(columns)}) "
        f"HAVING {filled} = {depth} AND ({depth} > 0 OR block = 0)", wide=wide,
    )
    turn = [F.col(c) for c in columns]
    last = F.coalesce(*reversed(turn))
    end = F.col("block") * WIDTH + F.col("k")
    halves = {}
    for half, start in ((1, "start_x"), (2, "start_y")):
        value = F.col(start)
        for i, t in enumerate(turn):
            value = value.bitwiseXOR(_hashed(t, F.col("block") * WIDTH + i, half))
        halves[half] = value
    node = F.struct(halves[1].alias("x"), halves[2].alias("y"))
    up = {half: value.bitwiseXOR(_hashed(last, end - 1, half)) for half, value in halves.items()}
    parent = F.when(F.col("k") > 0, F.struct(up[1].alias("x"), up[2].alias("y")))
    words = F.col("start_words")
    for t in turn:
        words = words + _words(t)
    kept = [c for c in found.columns if c not in ("block", "start_x", "start_y", "start_words", "k", *columns)]
    return found.select(node.alias("node"), parent.alias("parent"), end.alias("depth"), (words - _words(last)).alias("before"), _words(last).alias("last"), *kept)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, c) as runs of at most PIECE ids of one node, each with its first id and its text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, c = (batch.column(i).to_numpy() for i in range(3))
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        first = np.flatnonzero(new)
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
        cuts = np.flatnonzero(place % PIECE == 0)
        ids = ["" if v == NULL_ID else str(v) for v in c.tolist()]
        texts = [",".join(ids[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(c)], strict=True)]
        yield arrow_rows(["x", "y", "first", "ids"], [pa.int64()] * 3 + [pa.string()], [x[cuts], y[cuts], c[cuts], texts])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, from its pieces in order; one running hash, so a node's size does not matter."""
    at, running = None, None
    for batch in batches:
        done = []
        for x, y, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (x, y) != at:
                if at:
                    done.append((*at, running.hexdigest()))
                at, running = (x, y), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield arrow_rows(["x", "y", "sha"], [pa.int64(), pa.int64(), pa.string()], [list(c) for c in zip(*done, strict=True)] or [[], [], []])
    if at:
        yield arrow_rows(["x", "y", "sha"], [pa.int64(), pa.int64(), pa.string()], [[v] for v in (*at, running.hexdigest())])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(node, sha): SHA-256 of the ids c that end at each node, ascending and joined by commas."""
    rows = ends.select(F.col("node.x").alias("x"), F.col("node.y").alias("y"), "c")
    rows = rows.repartitionByRange(partitions(ends.sparkSession), "x", "y", "c").sortWithinPartitions("x", "y", "c")
    pieces = rows.mapInArrow(_pieces, "x long, y long, first long, ids string")
    pieces = pieces.repartition("x", "y").sortWithinPartitions("x", "y", "first")
    return pieces.mapInArrow(_hashes, "x long, y long, sha string").select(F.struct("x", "y").alias("node"), "sha")


def trie(turns: DataFrame) -> DataFrame:
    """A row for every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, of conversations given as c, pos (from 0, without gaps) and t.

    Rows with a null pos only make their conversation a member of the root. Without any row there is no node.

    A conversation owns the nodes of which it is the smallest member: all those of its path from some depth on. Sums
    over the nodes of a subtree are sums over its members of what they own, less what the subtree's own owner owns
    above it; so a first ROLLUP finds the owners, and a second one sums what they own.
    """
    blocks = _blocks(turns)
    nodes, _ = saved(_rolled_up(blocks, "min(c) AS c"), "nodes")
    convs = blocks.groupBy("c").agg(F.struct(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).alias("node"), F.sum("len").alias("len"), F.sum("words").alias("total"))
    convs, _ = saved(convs, "ends")
    # what each conversation owns, and the node below which that begins
    tops = nodes.groupBy("c").agg(F.sum("last").alias("own"), F.min("depth").alias("top"), F.min_by("parent", "depth").alias("under"))
    tops, _ = saved(tops, "tops")
    branches = tops.where("under is not null").groupBy(F.col("under").alias("node")).agg(F.count("*").alias("branches"))
    branches, _ = saved(branches, "branches")
    owners = convs.join(tops, "c").join(branches, "node", "left").select("c", "own", "top", "under", F.when(F.col("branches").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    above = attach(owners.where("under is not null"), nodes.select(F.col("node").alias("under"), F.col("c").alias("above")), "under").select("c", "above")
    owners = owners.drop("under").join(above, "c", "left")
    values = convs.select("c", F.col("len").alias("all"), "total").join(owners, "c", "left").fillna(0, ["own", "leaf"])
    values, _ = saved(values, "owners")
    first = ", ".join(f"min_by(`{v}`, c) AS `{v}`" for v in ("own", "total", "all", "top", "above"))
    summed = _rolled_up(attach(blocks, values, "c"), f"min(c) AS c, count(*) AS n, sum(leaf) AS leaves, sum(own) AS owned, sum(total) AS totals, {first}")
    ends = ends_hashes(convs)
    more = branches.select("node", "branches", F.lit(None).cast("string").alias("sha")).union(ends.select("node", F.lit(None).cast("long"), "sha"))
    more = more.groupBy("node").agg(F.max("branches").alias("branches"), F.max("sha").alias("sha"))
    out = summed.join(more, "node", "left")
    c, d, above_last = F.col("c"), F.col("depth"), F.col("before")
    distinct = F.col("owned") - F.col("own") + F.col("total") - above_last
    return out.select(
        unkey("c").alias("conv_id"), "depth", F.when(d > 0, unkey(F.when(d > F.col("top"), c).otherwise(F.col("above")))).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.coalesce("branches", F.lit(0)) + (d < F.col("all")).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("totals") - F.col("n") * above_last - distinct).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose first turns are shared within runs of ids (shared_heads).

    Null roles and texts are empty; a null conv_id is one conversation, smaller than all others, whose id is null and
    empty in lists; null turns come first. Rows that repeat conversation, turn, role and text are turns of their own;
    an empty table has no nodes. Texts differ where their digests of 128 bits do.
    """
    return trie(shared_heads(numbered_turns(conversations)))
