"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of ``bands`` signatures, each of two minhashes, are computed for every text; a table's key is a
pair of one signature of either collection. So 4 * bands minhashes give bands ** 2 tables of four minhashes each. Texts
that agree in J of their shingles miss all tables with a probability of about 2 * (1 - J ** 2) ** bands.

A signature that no other text has cannot be part of a shared key, so keys are formed from signatures that recur. Copies
of one shingle set are one class from the start. Links are sought in rounds: each text is first compared with the
smallest text with which it shares most keys, then with the smallest of every bucket it is in. What a bucket then still
holds of different groups is compared within the bucket, block by block. Buckets that share their first signature are
one unit of that work, so a text is sent to ``bands`` units at most, and a pair that shares several keys is compared in
the unit of the first signature alone. Texts of one group need no comparison with each other, so a large group of near
copies costs about one comparison a text. No bucket is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import WordHashes, attach, bounded_batches, components, fresh, hashed_texts, hot_keys, key, mixed, remove, saved, slices, text_hash, unkey

BANDS = 10
#: Pairs that share the text of their first document in one task.
_CHUNK = 500
#: Documents of a block of the last round.
_ROWS, _COLUMNS = 256, 1024
_RANDOM = np.random.default_rng(6011)
_HASHES = _RANDOM.integers(0, 2**63, (2, 4 * 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; of all words as one where there are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = words[: n - width + 1].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(words[i : n - width + 1 + i])
    return np.unique(mixed(out + np.uint64(width)))


def _least(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes."""
    a, b = _HASHES[:, :n]
    least = np.full(n, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        some = shingles[at : at + 2048]
        np.minimum(least, (a[:, None] * some + b[:, None]).min(axis=1), out=least)
    return least


def signatures(shingles: np.ndarray, bands: int) -> np.ndarray:
    """2 * bands signatures; the second half is the second collection."""
    low = mixed(_least(shingles, 4 * bands)).reshape(2 * bands, 2)
    place = np.arange(2 * bands, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mixed(low[:, 0] * np.uint64(3) + low[:, 1] + place)


def _sketches(docs: DataFrame, bands: int, size: int) -> DataFrame:
    """(k, text_hash, n_shingles, e1, e2, signatures): e1 and e2 are a 128-bit digest of the set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHashes()
        for batch in batches:
            for some in slices(batch):
                ns, e1, e2, sigs = [], [], [], []
                for body in some.column(2).to_pylist():
                    found = shingle_set(known.of(body.lower().split()), size)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
                    ns.append(len(found))
                    e1.append(int(digest[0]))
                    e2.append(int(digest[1]))
                    sigs.append(signatures(found, bands).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(ns, pa.int64()), pa.array(e1, pa.int64()), pa.array(e2, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["k", "text_hash", "n_shingles", "e1", "e2", "signatures"])

    return hashed_texts(docs).mapInArrow(sketch, "k long, text_hash long, n_shingles long, e1 long, e2 long, signatures array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, size: int, paths: list[str]) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union on full sets.

    The text of ``a`` is sent once for each 500 of its pairs, so a text with many partners is dealt to many tasks.
    """
    chunks = F.expr(f"pmod(xxhash64(b), (n_pairs + {_CHUNK - 1}) div {_CHUNK})")
    counts, counts_path = saved(pairs.groupBy("a").agg(F.count("*").alias("n_pairs")), "near-counts")
    paths.append(counts_path)
    left = attach(pairs, counts, "a", hot=hot_keys(counts, "a", "n_pairs")).withColumn("chunk", chunks).join(texts.select(F.col("k").alias("b"), F.col("body").alias("body_b")), "b")
    heads = counts.join(texts.select(F.col("k").alias("a"), F.col("body").alias("body_a")), "a")
    heads = heads.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n_pairs + {_CHUNK - 1}) div {_CHUNK} - 1L)"))).select("a", "chunk", "body_a")
    both = left.select("a", "b", "chunk", "body_b").join(heads, ["a", "chunk"]).select("a", "b", "body_a", "body_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, first = WordHashes(), None, None
        of = lambda body: shingle_set(known.of(body.lower().split()), size)
        for batch in batches:
            a, b, bodies_a, bodies_b = batch.columns
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i].as_py() != last:
                    last, first = a[i].as_py(), of(bodies_a[i].as_py())
                second = of(bodies_b[i].as_py())
                common = np.intersect1d(first, second, assume_unique=True).size
                ok[i] = common and 100 * common >= percent * (len(first) + len(second) - common)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(ok)], names=["a", "b", "ok"])

    return both.mapInArrow(compare, "a long, b long, ok boolean")


def _across(docs: DataFrame, texts: DataFrame, percent: int, size: int, bands: int, paths: list[str]) -> DataFrame:
    """Links (a, b) between the groups of texts that share a signature and a key; docs: (k, root, cluster), the cluster
    being a signature of the first collection, texts: (k, body, signatures).

    Members of a cluster's largest group are compared with the others only. The others are dealt in blocks of about
    ROWS documents, all documents in blocks of about COLUMNS, and a task compares a block of each by an index from
    shingles to the documents that hold them; it emits no more links than documents, as pairs of groups.
    """
    sizes = docs.groupBy("cluster", "root").count()
    sizes = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum("count").alias("n"), F.max("count").alias("most"))
    sizes, path = saved(sizes.where("n > most"), "near-sizes")
    paths.append(path)
    placed = attach(docs, sizes, "cluster", hot=hot_keys(sizes, "cluster", "n"))
    blocks = lambda n, of: F.expr(f"({n} + {of - 1}) div {of}")
    placed = placed.withColumns({"rows": blocks("(n - most)", _ROWS), "columns": blocks("n", _COLUMNS)})
    in_row, in_column = F.expr("pmod(xxhash64(k), rows)"), F.expr("pmod(xxhash64(k, 1), columns)")
    left = placed.where("root <> largest").select("cluster", "k", "root", in_row.alias("i"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("j"), F.lit(0).alias("side"))
    right = placed.select("cluster", "k", "root", F.explode(F.expr("sequence(0L, rows - 1)")).alias("i"), in_column.alias("j"), F.lit(1).alias("side"))
    both = left.unionByName(right).join(texts, "k").select("cluster", "i", "j", "side", "root", "body", "signatures")
    both = both.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        unit, marks, roots, sets, index = None, [], [], [], None
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for batch in batches:
            made = []
            for n, (cluster, i, j, side, root, body) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:6]], strict=True)):
                mark = batch.column(6)[n].values.to_numpy()
                if unit != (cluster, i, j):
                    unit, marks, roots, sets, index = (cluster, i, j), [], [], [], None
                    up.clear()
                if not side:
                    marks.append(mark)
                    roots.append(root)
                    sets.append(shingle_set(known.of(body.lower().split()), size))
                    continue
                if not roots:
                    continue
                if index is None:
                    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], np.array([len(s) for s in sets]), np.array(roots), np.stack(marks)
                shingles, owner, lengths, own_roots, own_marks = index
                same = own_marks == mark
                # pairs that share a key, of another group, and no signature of the first collection before this one
                meet = same[:, bands:].any(1) & (mark[same[:, :bands].argmax(1)] == cluster) & (own_roots != root)
                if not meet.any():
                    continue
                found = shingle_set(known.of(body.lower().split()), size)
                a, b = np.searchsorted(shingles, found), np.searchsorted(shingles, found, side="right")
                n = b - a
                at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(lengths))
                ok = meet & (common > 0) & (100 * common >= percent * (lengths + len(found) - common))
                for r in np.flatnonzero(ok).tolist():
                    x, y = top(roots[r]), top(root)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        made.append((roots[r], root))
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _grouped(docs: DataFrame, percent: int, size: int, bands: int) -> DataFrame:
    """k, text_hash, n_shingles, component (k of the first of the row's component) and kept for each row."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    # ids may recur, so a row goes by its number in the table of sketches, and a class by the number of its first row
    sketches, _ = saved(_sketches(docs, bands, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("e1", "e2").agg(F.min(F.struct("k", "text_hash", "row")).alias("own"), F.first("signatures").alias("signatures"))
    classes = classes.withColumn("rep", F.col("own.row"))

    # signatures that recur, by class
    each = classes.select(F.col("rep").alias("k"), F.posexplode("signatures").alias("place", "signature"))
    again, again_path = saved(each.groupBy("signature").count().where("count > 1"), "signatures-again")
    live = attach(each, again.select("signature"), "signature", hot=hot_keys(again, "signature", "count"))
    live = live.groupBy("k").agg(F.collect_list(F.struct("place", "signature")).alias("s"))
    pairs_of = F.expr(f"""flatten(transform(filter(s, x -> x.place < {bands}), x ->
        transform(filter(s, y -> y.place >= {bands}), y -> struct(xxhash64(x.signature, y.signature) AS bucket, x.signature AS half))))""")
    keys, keys_path = saved(live.select("k", F.inline(pairs_of)), "buckets-all")
    hubs, hubs_path = saved(keys.groupBy("bucket").agg(F.min("k").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets-hubs")
    hot = hot_keys(hubs, "bucket", "n")
    members, members_path = saved(attach(keys, hubs.select("bucket", "hub"), "bucket", hot=hot), "buckets")
    remove(spark, again_path, keys_path, hubs_path)

    wanted = members.select("k").distinct()
    wanted = wanted.join(classes.select(F.col("rep").alias("k"), F.col("own.k").alias("id"), F.col("own.text_hash").alias("text_hash"), "signatures"), "k")
    bodies = hashed_texts(docs).withColumnRenamed("k", "id").join(wanted, ["id", "text_hash"])
    texts, texts_path = saved(bodies.select("k", "body", "signatures").dropDuplicates(["k"]), "bucket-texts")

    paths: list[str] = []

    def attempt(pairs: DataFrame) -> DataFrame:
        got, path = saved(_linked(pairs, texts, percent, size, paths), "near-links")
        paths.append(path)
        return got.where("ok").select("a", "b")

    stars = members.where("k <> hub").groupBy("k", "hub").count()
    best = stars.groupBy("k").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    links = attempt(best.select(F.col("hub").alias("a"), F.col("k").alias("b")))
    # then all other hubs, less those that hang on the same first hub as the text itself
    star, star_path = saved(links.select(F.col("b").alias("k"), F.col("a").alias("head")), "near-stars")
    paths.append(star_path)
    others = stars.select("k", "hub").join(best, ["k", "hub"], "left_anti").join(star, "k", "left").select("k", "hub", F.coalesce("head", "k").alias("own"))
    others = attach(others, star.select(F.col("k").alias("hub"), F.col("head").alias("hub_head")), "hub", "left")
    links = links.unionByName(attempt(others.where("own <> coalesce(hub_head, hub)").select(F.col("hub").alias("a"), F.col("k").alias("b"))))
    labels, path = components(links, "near-components")
    paths.append(path)
    got = members.join(labels, members.k == labels.node, "left").select("bucket", "half", "k", F.coalesce("root", "k").alias("root"))
    several = got.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    units = attach(got, several.select("bucket"), "bucket", hot=hot).select("k", "root", F.col("half").alias("cluster")).distinct()
    units, units_path = saved(units, "near-units")
    across, across_path = saved(_across(units, texts, percent, size, bands, paths), "near-across")
    # groups that the last round joined: their roots hang together, and their members follow
    joined, joined_path = components(across, "near-joined")
    labels = labels.unionByName(joined.select("node", F.col("node").alias("root")).join(labels.select("node"), "node", "left_anti"))
    labels = attach(labels, joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    labels, path = saved(labels.select("node", F.coalesce("last", "root").alias("root")), "near-groups")
    remove(spark, texts_path, members_path, units_path, across_path, joined_path, *paths)

    heads = labels.join(classes.select("own", "rep"), labels.node == F.col("rep")).groupBy("root").agg(F.min("own").alias("head"))
    heads = attach(labels, heads, "root").select("node", "head")
    owners = classes.select("e1", "e2", "own", "rep").join(heads, F.col("rep") == F.col("node"), "left")
    digest = F.struct("e1", "e2").alias("digest")
    owners = owners.select(digest, F.coalesce("head", "own").alias("head"))
    # texts without shingles share a digest and are no class: they bypass the join; a text of many copies is spread
    some = sketches.where("n_shingles > 0").select("k", "text_hash", "row", "n_shingles", digest)
    some = attach(some, owners, "digest").select("k", "text_hash", "n_shingles", F.col("head.k").alias("component"), (F.col("row") == F.col("head.row")).alias("kept"))
    return some.unionByName(sketches.where("n_shingles = 0").select("k", "text_hash", "n_shingles", F.col("k").alias("component"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept (its component's first).

    Documents are linked if their sets of ``size``-word shingles (white space splits, A-Z are folded) agree in at least
    ``percent`` of their union. Texts with fewer words have one shingle of all words; null, empty and blank texts have
    none and link with nothing. A null id counts as the smallest. Rows that repeat an id are documents of their own and
    share a component only if they link; one row of a component is kept, by id, then by a hash of the text. An empty
    table gives no rows.
    """
    rows = _grouped(docs, percent, size, bands)
    return rows.select(unkey("k").alias("doc_id"), "n_shingles", unkey("component").alias("component_id"), "kept")


def keep_first(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = BANDS) -> DataFrame:
    """The documents, all columns, that are the first of their group of near duplicates."""
    k, text, again = fresh(docs, "_k", "_text", "_again")
    rows = _grouped(docs, percent, size, bands).groupBy(F.col("k").alias(k), F.col("text_hash").alias(text))
    # one of the rows that agree in id and text is kept, but all of those without shingles
    kept = rows.agg(F.max("kept").alias("kept"), ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias(again)).where("kept").drop("kept")
    kept, _ = saved(kept, "near-kept")
    keyed = docs.withColumns({k: key(), text: text_hash()})
    out = keyed.join(kept.where(~F.col(again)), [k, text], "left_semi")
    if kept.where(again).limit(1).count():
        out = out.unionByName(keyed.join(kept.where(again), [k, text], "left_semi").dropDuplicates([k, text]))
    return out.select(*docs.columns)
