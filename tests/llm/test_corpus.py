"""Corpus operators against brute force on a small fixture with nulls, empty and long texts, copies and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import common, decontaminate, embedding_dedup, encode, minhash_dedup, ngram_lm, packing, quality, sharding, suffix_dedup, token_store, toxicity
from scenelake.llm.common import scratch_path

TOKENIZER = "byte_bpe_50k.json"
RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdeéßñ") for _ in range(RNG.randint(1, 8))) for _ in range(400)]


def text(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


ITEMS = [(0, text(20)), (1, text(13)), (2, "Short item é here"), (3, None), (4, ""), (5, text(30))]


def documents() -> list[tuple]:
    base, line = text(120), text(25)
    near = base.split()
    near[60] = "changed"
    rows = [base, base, " ".join(near), None, "", "  \n", "one two", "ONE two", text(9000), "ab" * 400, "x" * 350]
    rows += [text(30) + "\n" + line + "\n" + text(30) for _ in range(6)]
    rows += [text(10) + " " + ITEMS[0][1] + " " + text(5), text(400) + " " + ITEMS[1][1], "short ITEM É here", "tab\there  two\r\n\n<|endoftext|> it's 12"]
    rows += [text(RNG.randint(1, 60)) for _ in range(20)]
    return [(i if i != 7 else None, t, "en", "s", 1, 2.0, "c") for i, t in enumerate(rows)]


ROWS = documents()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(len(ROWS))] + [(None, 1, 1), (3, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def low(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rank(k):
    return -(2**63) if k is None else k


def test_suffix_dedup(docs, empty):
    seen: dict[bytes, tuple] = {}
    texts = sorted((rank(r[0]), (r[1] or "").encode()) for r in ROWS)
    for k, b in texts:
        for i in range(len(b) - 99):
            seen.setdefault(b[i : i + 100], (k, i))
    got = {rank(r["doc_id"]): r for r in suffix_dedup.dedup_windows(docs).collect()}
    assert len(got) == len(ROWS)
    for k, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] < (k, i):
                gone[i : i + 100] = True
        want = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
        assert tuple(got[k])[1:5] == want
    assert suffix_dedup.dedup_windows(empty).count() == 0
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[1] in ("", None)


def test_suffix_dedup_of_a_text_beyond_16_mib(spark):
    body = np.random.default_rng(12).integers(48, 112, (1 << 24) + 400_000, np.uint8).tobytes()
    # repeats before, across and behind 2**24, each of a passage of its own between bytes that differ
    gone = np.zeros(len(body), bool)
    for at, to in ((1000, 5_000_000), (2000, (1 << 24) - 150), (3000, (1 << 24) + 200_000)):
        body = body[: to - 1] + b"!" + body[at : at + 300] + b"!" + body[to + 301 :]
        gone[to : to + 300] = True
    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
    (got,) = suffix_dedup.dedup_windows(spark.createDataFrame([(1, body.decode())], "doc_id long, text string")).collect()
    assert tuple(got) == (1, len(body), 900, 3, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_shuffles_chunks_pressed(spark):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), (20, None), (21, "")], "doc_id long, text string")
    with common.scratch(spark):
        chunks, _ = suffix_dedup._packed(docs, 100)
        size, stored = chunks.agg(F.sum("n"), F.sum(F.length("body"))).first()
    assert size == sum(map(len, texts)) and stored < 0.6 * size
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in suffix_dedup.dedup_windows(blank).collect()] == [(0, 0, 0)] * 2


def test_suffix_dedup_of_repeated_ids(spark):
    rng = random.Random(22)
    # capitals end texts and passages, so that no repeat goes on by chance
    a, b, c, d = (x + "".join(rng.choices("abcdefghijklmnop", k=398)) + x.upper() for x in "wxyz")
    d = d[:150] + "D" + d[151:]
    # within b + d[:150] * 2 the second d[:150] repeats; d comes later by id, as do the copies of c
    rows = [(None, a), (None, b + d[:150] * 2), (None, c), (None, c), (None, "short"), (None, "short"), (None, None), (4, a + d), (4, d[200:]), (4, "x" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_windows(docs).collect())
    # by a hash of the text, either a + d or d[200:] counts as the earlier of the two that share id 4
    first = sorted([(400, 0, 0), (700, 150, 1), (400, 0, 0), (400, 400, 1), (5, 0, 0), (5, 0, 0), (0, 0, 0), (99, 0, 0)])
    assert got in (sorted([*first, (800, 550, 1), (200, 200, 1)]), sorted([*first, (800, 750, 2), (200, 0, 0)]))
    cut = [r["text"] for r in suffix_dedup.remove_repeats(docs).collect()]
    assert len(cut) == len(rows) and cut.count(None) == 1
    assert cut.count(a) == 1 and cut.count(c) == 1 and cut.count("short") == 2 and cut.count(b + d[:150]) == 1 and cut.count("x" * 99) == 1


def test_repeated_ids_do_not_crash(docs):
    twice = docs.unionByName(docs)
    assert suffix_dedup.remove_repeats(twice).count() == 2 * len(ROWS)
    assert minhash_dedup.near_duplicates(twice).count() == 2 * len(ROWS)
    assert packing.pack(twice, TOKENIZER).count() == 2 * packing.pack(docs, TOKENIZER).count()


def test_near_duplicates(docs, empty):
    sets, up = {}, {}
    for r in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r[1]))
        sets[rank(r[0])] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 75 * len(sets[a] | sets[b]) and up[a] != up[b]:
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    got = {rank(r["doc_id"]): r for r in minhash_dedup.near_duplicates(docs).collect()}
    for k in sets:
        assert (got[k]["n_shingles"], rank(got[k]["component_id"]), got[k]["kept"]) == (len(sets[k]), up[k], up[k] == k)
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert sorted(rank(r["doc_id"]) for r in minhash_dedup.keep_first(docs).collect()) == sorted(k for k in up if up[k] == k)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(21)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "abcd")
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    # (id, text, component)
    rows = [(3, a, 3), (5, near(a), 3), (5, b, 5), (5, b + " ", 5), (6, near(b), 5), (None, c, None), (None, d, None), (None, d, None), (9, near(c), None)]
    rows += [(None, "", None), (None, " ", None), (None, None, None), (7, "", 7), (7, "", 7)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert sorted((rank(r["doc_id"]), r["n_shingles"], rank(r["component_id"])) for r in got) == sorted((rank(i), max(0, len((t or "").split()) - 4), rank(c)) for i, t, c in rows)
    # a and near(a), b with its copy and near(b), c and near(c), d and its copy: one each; blank texts stay
    assert sum(r["kept"] for r in got if r["n_shingles"]) == 4 and all(r["kept"] for r in got if not r["n_shingles"])
    kept = sorted((rank(r["doc_id"]), (r["text"] or "").strip()) for r in minhash_dedup.keep_first(docs).collect())
    assert kept == sorted([(rank(None), c), (rank(None), d), (3, a), (5, b)] + [(rank(None), "")] * 3 + [(7, "")] * 2)


def test_components(spark):
    rng, up = random.Random(8), {}
    edges = [(i, i + 1) for i in range(300, 700)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    for _ in range(700):
        changed = False
        for a, b in edges:
            if a is not None and a != b and up.get(a, a) != up.get(b, b):
                up[a] = up[b] = min(up.get(a, a), up.get(b, b))
                changed = True
        if not changed:
            break
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    for parts in (1, 7):
        got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(parts))[0].collect()
        assert {r["node"]: r["root"] for r in got} == {x: up.get(x, x) for x in nodes} and len(got) == len(nodes)
    assert common.components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    pattern, windows = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), collections.defaultdict(set)
    for i, t in ITEMS:
        w = pattern.findall(low(t))
        for j in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[j : j + 13])].add(str(i))
    for size in (1 << 24, 100):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items, shard_bytes=size).collect()}
        for r in ROWS:
            w, hit, found = pattern.findall(low(r[1])), set(), set()
            for i in range(len(w)):
                for n in {len(x) for x in windows}:
                    if len(w) >= i + n and tuple(w[i : i + n]) in windows:
                        hit |= {*range(i, i + n)}
                        found |= windows[tuple(w[i : i + n])]
            want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
            assert tuple(got[r[0]])[1:6] == want
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    bad = {k for k, r in got.items() if r["contaminated"]}
    for size in (1 << 24, 100):
        kept = decontaminate.decontaminate(docs.unionByName(docs), items, shard_bytes=size)
        assert kept.columns == docs.columns
        assert bad and collections.Counter(r["doc_id"] for r in kept.collect()) == {r[0]: 2 for r in ROWS if r[0] not in bad}


def test_long_items_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    item = text(60)
    words = decontaminate.words_of(item.encode())
    docs = spark.createDataFrame([(1, " ".join(w.decode() for w in words[20:45])), (2, "zz " + " ".join(w.decode() for w in words[20:32]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[2]["n_hit"]) == (25, 25, 1, 0)


def test_spans_are_removed(spark):
    item, rest = text(14), [text(200), text(200)]
    body = f"{rest[0]} <<{item}>> {rest[1]}"
    docs = spark.createDataFrame([(1, body, len(body), "a"), (1, rest[0], len(rest[0]), "b"), (2, None, None, "c")], "doc_id long, text string, n_chars long, _body string")
    items = spark.createDataFrame([(0, item), (1, item[:20])], "item_id long, text string")
    for size in (1 << 20, 8):
        out = {r["_body"]: r for r in decontaminate.decontaminate(docs, items, longest=12, shard_bytes=size).collect()}
        words = decontaminate.words_of(body.encode())
        inner = decontaminate.words_of(item.encode())
        left = decontaminate.words_of(out["a"]["text"].encode())
        assert len(left) == len(words) - 14 and out["a"]["n_chars"] == len(out["a"]["text"])
        assert not any(left[i : i + 13] == inner[:13] for i in range(len(left)))
        assert out["b"]["text"] == rest[0] and out["c"]["text"] is None
        kept = decontaminate.decontaminate(docs, items, longest=14, shard_bytes=size).collect()
        assert {r["text"] for r in kept} == {body, rest[0], None}


def test_encoder_equals_the_library():
    e = encode.Encoder(encode.vocabulary())
    texts = [r[1] or "" for r in ROWS] + ["a b", "日本 語\nab", "don't we'll 'd x'", " lead", "trail ", "a\n b"]
    assert e.by_piece and e.encode(texts) == [e._whole(t) for t in texts]


def test_token_store(spark, docs, empty):
    path = scratch_path(spark, "store")
    token_store.write_store(docs, path, TOKENIZER, length=64)
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: rank(r["doc_id"]))
    e, start = encode.Encoder(encode.vocabulary()), 0
    for r, (_, t) in zip(got, sorted((rank(x[0]), x[1] or "") for x in ROWS), strict=True):
        raw = e._whole(t) + np.array([2], "<u4").tobytes()
        assert tuple(r)[1:] == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    sequences = token_store.read_sequences(spark, path).collect()
    assert sum(r["n_ids"] for r in sequences) == start and {len(r["ids"]) for r in sequences} == {64}
    other = scratch_path(spark, "store")
    token_store.write_store(empty, other, TOKENIZER)
    assert token_store.read_documents(spark, other).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, TOKENIZER).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    assert {rank(r["doc_id"]) for r in rows} == {rank(r[0]) for r in ROWS}
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_fullest_combination():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * i for s in sums for i in range(v + 1)}
        taken = packing.fullest(counts, 40)
        assert sum(k * v for k, v in taken.items()) == max(s for s in sums if s <= 40)
        assert all(v <= counts[k] for k, v in taken.items())


def test_shards(docs, empty):
    rows = sharding.hilbert_shards(docs, 5).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(ROWS) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    bodies = {rank(r[0]): (r[1] or "").encode() for r in ROWS}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(bodies[rank(r["doc_id"])]) + 8, zlib.crc32(bodies[rank(r["doc_id"])]), "rows", None) for r in rows)
    # the same order by brute force: one place a text, on the curve over ranks of lang and source, and size
    first = {}
    for r in sorted(ROWS, key=lambda r: rank(r[0])):
        first.setdefault((r[1] or "").encode(), r)
    order = {b: i for i, b in enumerate(sorted(first, key=lambda b: (curve_place(first, b), rank(first[b][0]))))}
    places = [order[bodies[rank(r["doc_id"])]] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert places == sorted(places)
    assert sharding.hilbert_shards(empty).count() == 0
    twice = sharding.hilbert_shards(docs.unionByName(docs), 7)
    counts = collections.Counter(r["shard"] for r in twice.collect())
    assert sum(counts.values()) == 2 * len(ROWS) and max(counts.values()) - min(counts.values()) <= 1


def curve_place(first: dict, body: bytes, bits: int = 7) -> int:
    """Where a text lies: lang and source are the same for all rows of the fixture, so cells differ by size alone."""
    sizes = sorted(len(b) + 8 for b in first)
    cuts = np.unique([sizes[max(0, int(np.ceil(i / (1 << bits) * len(sizes))) - 1)] for i in range(1, 1 << bits)])
    return int(sharding.hilbert_index(np.array([[0, 0, np.searchsorted(cuts, len(body) + 8, side="left")]]), bits)[0])


def test_attach_spreads_a_key_with_most_rows(spark):
    """Also a key of several columns, and right rows that are absent."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(20_000).selectExpr("struct(CASE WHEN id < 15000 THEN 7 ELSE id END AS a, 'x' AS b) AS key", "id")
        right = left.select("key").distinct().where("key.a % 2 = 1").selectExpr("key", "key.a * 2 AS value")
        out = common.attach(left, right, "key", "left")
        held = out.groupBy(F.spark_partition_id()).count().collect()
        got = {r["id"]: r["value"] for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 20_000 and all(got[i] == 14 for i in range(15_000)) and got[15_000] is None and got[15_001] == 30_002
    assert max(r["count"] for r in held) < 2 * 20_000 / 8


def test_few_files_are_open_at_once(spark, tmp_path):
    for i in range(5):
        common.write_arrays(f"file://{tmp_path}", f"part-{i:03d}", {"x": np.arange(i + 1)})
    found = common.Mapped(f"file://{tmp_path}", "part-{:03d}", files=2)
    assert [found[i]["x"].tolist() for i in (0, 3, 1, 4, 0)] == [list(range(i + 1)) for i in (0, 3, 1, 4, 0)]
    assert len(found) == 2 and found[9] == {} and len(found) == 2


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 1), (2, 4), (3, 1), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dimensions, bits):
    """What makes a Hilbert curve: all cells once, each next to the one before, and aligned blocks without a break."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    place = sharding.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    for b in range(1, bits):
        blocks = (path >> b) @ (1 << bits * np.arange(dimensions))
        assert (np.diff(blocks) != 0).sum() + 1 == len(np.unique(blocks))


def test_shards_follow_the_curve_of_three_dimensions(spark):
    """Order of documents of many languages, sources and sizes, by a curve that is looked up in its list of cells."""
    rng, bits = random.Random(12), 2
    rows = [(i, "t" * rng.randint(0, 60) + str(i), rng.choice(["de", "en", None, "fr"]), rng.choice([f"s{j}" for j in range(9)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = [tuple(c) for c in sorted(itertools.product(range(4), repeat=3), key=lambda c: int(sharding.hilbert_index(np.array([c]), bits)[0]))]
    columns = []
    for values in ([r[2] or "" for r in rows], [r[3] for r in rows]):
        names = sorted(set(values))
        columns.append([names.index(v) for v in values])
    columns.append([len(r[1].encode()) + 8 for r in rows])
    cells = []
    for values in columns:
        ranked = sorted(values)
        cuts = sorted({ranked[max(0, -(-i * len(ranked) // 4) - 1)] for i in (1, 2, 3)})
        cells.append([sum(c < v for c in cuts) for v in values])
    want = sorted(range(300), key=lambda i: (path.index(tuple(c[i] for c in cells)), i))
    got = sharding.hilbert_shards(docs, 7, bits).orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in got] == want


def test_cuts_keep_groups_together():
    rng = random.Random(7)
    for _ in range(200):
        n, shards = rng.randint(0, 60), rng.randint(1, 9)
        inside = {i for i in range(1, n) if rng.random() < 0.5}
        cuts = [0, *sharding.cuts_of(n, shards, lambda ranks: set(ranks) & inside), n]
        sizes = np.diff(cuts)
        assert len(sizes) == shards and sizes.max() - sizes.min() <= 1
        base, extra = divmod(n, shards)
        # the fewest cuts inside a group, over all ways to say which shards have one row more
        options = [sum(c in inside for c in np.cumsum([base + (i in more) for i in range(shards)])[:-1]) for more in itertools.combinations(range(shards), extra)]
        assert sum(c in inside for c in cuts[1:-1]) == min(options)


def test_shards_are_pruned_by_source(spark):
    rng = random.Random(3)
    rows = [(i, f"text {i}", rng.choice("ab"), f"https://example.org/{rng.randrange(30):02d}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, path, 24)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("doc_id", "text", "lang", "source").collect())) == rows
    ranges = back.groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b")).collect()
    read = np.mean([sum(r["a"] <= s <= r["b"] for r in ranges) for s in {r[3] for r in rows}])
    assert len(ranges) == 24 and read <= 8  # of 24; sources share their first 20 bytes


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    path = cells[np.argsort(sharding.hilbert_index(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def kneser_ney(texts: list[list[str]], order: int):
    """Brute force: the probability of a word after others, by recursion over the orders."""
    pad = [" "] * (order - 1)
    grams = [tuple((pad + ws)[i : i + order]) for ws in texts for i in range(len(ws))]
    counts = {order: collections.Counter(grams)}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    d, after = {}, {}
    for n, c in counts.items():
        d[n] = ngram_lm.discounts([sum(x == i for x in c.values()) for i in (1, 2, 3, 4)])
        after[n] = collections.defaultdict(list)
        for g, x in c.items():
            after[n][g[:-1]].append(x)
    words = len(counts[1])

    def p(gram: tuple) -> float:
        n = len(gram)
        if not n:
            return 1 / (words + 1)
        rest, total = after[n].get(gram[:-1], []), sum(after[n].get(gram[:-1], []))
        if not total:
            return p(gram[1:])
        c = counts[n][gram]
        return (max(c - d[n][min(c, 3)], 0) + sum(d[n][min(x, 3)] for x in rest) * p(gram[1:])) / total

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, empty, order):
    got = {rank(r["doc_id"]): r for r in ngram_lm.scores(docs, order=order).collect()}
    split = {rank(r[0]): [*re.findall(r"[^\x20\x09-\x0D]+", low(r[1])), "\n"] for r in ROWS}
    held = {rank(r[0]): zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in ROWS}
    counts = collections.Counter(w for k, ws in split.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    p = kneser_ney([ws for k, ws in split.items() if not held[k]], order)
    for k, ws in split.items():
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert got[k]["held_out"] == held[k] and got[k]["train_tokens"] == n
        assert (got[k]["n_tokens"], got[k]["n_known"]) == (len(ws), sum(w in counts for w in ws))
        assert got[k]["base_score"] == pytest.approx(base)
        # words that training has not seen share what is left over for one
        padded = [" "] * (order - 1) + [w if w in counts else None for w in ws]
        assert got[k]["score"] == pytest.approx(sum(np.log10(p(tuple(padded[i : i + order]))) for i in range(len(ws))), rel=1e-9)
    assert ngram_lm.scores(empty, order=order).count() == 0
    if order == 3:
        twice = ngram_lm.scores(docs.unionByName(docs)).collect()
        assert len(twice) == 2 * len(ROWS) and {r["train_tokens"] for r in twice} == {2 * n}
        assert all(r["score"] == 0 and r["n_known"] == 0 for r in ngram_lm.scores(docs.where("doc_id = 1"), divisor=1, held=0).collect())


def test_counts_have_no_upper_limit(spark):
    counts = np.array([1, 254, 255, 256, 2**32 - 1, 2**32, 2**40], np.int64)
    path = scratch_path(spark, "counts")
    common.write_arrays(path, "x", ngram_lm._counted("n", counts))
    assert (ngram_lm._counts(common.mapped_arrays(path, "x"), "n", np.arange(len(counts))) == counts).all()


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity])
def test_classifiers_take_every_row(docs, empty, labels, scores):
    rows = scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert scores(empty, labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == len(ROWS)


def test_toxicity_finds_sentences(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(WORDS) for _ in range(8)) + "."
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        parts = [clean() for _ in range(6)]
        if bad:
            parts[2] = "you vileword " + parts[2]
        rows.append((i, " ".join(parts)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i, _ in marks if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == marks[i][1] for i in held) >= 0.95 * len(held)
    found = toxicity.offending_sentences(docs, toxicity.train(docs, labels)).where("doc_id = 0").collect()
    assert any("vileword" in rows[0][1].encode()[r["start"] : r["stop"]].decode() for r in found)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64))
    near = [x[0] + 0.1 * rng.normal(size=64) for _ in range(20)] + [x[1], x[1] * 2, x[1]]
    vectors = [v.tolist() for v in [*x, *near]] + [None, [], [0.0] * 64, [None] * 64, [float("nan")] * 64, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")).collect()}
    assert len(got) == len(rows)
    f = [np.array(v, np.float32).astype(float) if v and None not in v and np.isfinite(v).all() and np.any(v) else None for v in vectors]
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    up = list(range(len(f)))
    for _ in range(5):
        for i in range(len(f)):
            for j in range(len(f)):
                if i != j and link(f[i], f[j]):
                    up[i] = up[j] = min(up[i], up[j])
    for i in range(len(f)):
        assert got[i]["n_links"] == sum(link(f[i], f[j]) for j in range(len(f)) if j != i), i
        assert (got[i]["component_id"], got[i]["kept"]) == (up[i], up[i] == i)
