"""Training steps against plain loops, recall on planted pairs, clashing columns, and the pipeline stage by stage."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from scenelake.llm import common, decontaminate, embedding_dedup, encode, minhash_dedup, ngram_lm, packing, pipeline, quality, sharding, suffix_dedup, token_store, toxicity

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(600)]
TOKENIZER = "byte_bpe_50k.json"


def text(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- quality and toxicity ------------------------------------------------------------------------------------------


def test_ftrl_equals_plain_loops():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        at = rng.choice(30, size=rng.integers(1, 8), replace=False).astype(np.int64)
        rows.append((at, rng.random(len(at)).astype(np.float32), int(rng.random() < 0.5)))
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 1.0
    z, n = [0.0] * 30, [0.0] * 30

    def weight(i: int) -> float:
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            at, v, y = rows[r]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(w, v, strict=True))))
            for i, wi, vi in zip(at, w, v, strict=True):
                g = (p - y) * float(vi)
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * wi
                n[i] += g * g
    assert np.allclose(quality.ftrl(rows, 30), [weight(i) for i in range(30)], rtol=1e-4, atol=1e-6)


def test_quality_is_learnt_from_text_alone(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        good = i % 2
        rows.append((i, text(30, rng) + "." if good else "$$ " + " !! ".join(text(2, rng).upper() for _ in range(10)), "en", "s"))
        marks.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    held = [i for i, _ in marks if out[i]["held_out"]]
    assert len(held) > 50 and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    assert sum(out[i]["predicted"] == marks[i][1] for i in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in out.items() if r["predicted"]}


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)] + [(7, "y" * 100), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    of = lambda **bounds: quality.labelled(docs, labels, "quality", 10**9, -1, **bounds).collect()
    assert len(of()) == 201 and collections.Counter(r["y"] for r in of(most=40)) in ({0: 20, 1: 20}, {0: 20, 1: 21})
    assert 20 <= len(of(most_bytes=2000)) <= 22 and len(of(most_bytes=1)) in (1, 2)


def test_noisy_or_equals_plain_loops():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        at, start = [], []
        for _ in range(rng.integers(1, 4)):
            start.append(len(at))
            at += [0, *rng.integers(1, 6, size=rng.integers(0, 4)).tolist()]
        rows.append((np.array(at), np.array(start), int(i % 3 == 0)))
    seen = collections.Counter(p for at, *_ in rows for p in set(at.tolist()))
    used = sorted({0, *(p for p, c in seen.items() if c >= toxicity.LEAST_DOCUMENTS)})
    w, n = {p: 0.0 for p in used} | {0: -6.0}, dict.fromkeys(used, 1.0)
    for _ in range(20):
        g = dict.fromkeys(used, 0.0)
        for at, start, y in rows:
            parts = [at[a:b].tolist() for a, b in zip(start, [*start[1:], len(at)], strict=True)]
            ps = [1 / (1 + math.exp(-sum(w.get(p, 0.0) for p in part))) for part in parts]
            clean = math.prod(1 - p for p in ps)
            blame = -clean / max(1e-9, 1 - clean) if y else 1.0  # the likelihood's slope by each sentence's score
            for part, p in zip(parts, ps, strict=True):
                for place in part:
                    if place in g:
                        g[place] += p * blame
        for p in used:
            n[p] += g[p] ** 2
            step = 1 / math.sqrt(n[p])
            new = w[p] - step * g[p]
            w[p] = new if p == 0 else math.copysign(max(0.0, abs(new) - step * 0.5), new)
    places, weights = toxicity.fit(rows, 8, rounds=20)
    got = dict(zip(places.tolist(), weights.tolist(), strict=True))
    for p in used:
        assert got.get(p, 0.0) == pytest.approx(w[p], rel=1e-4, abs=1e-6)
    dense = np.zeros(8, np.float32)
    dense[places] = weights
    at, start, _ = rows[0]
    parts = [at[a:b] for a, b in zip(start, [*start[1:], len(at)], strict=True)]
    want = 1 - math.prod(1 - 1 / (1 + math.exp(-float(dense[p].sum()))) for p in parts)
    assert toxicity.document_score(dense, at, start) == pytest.approx(want, rel=1e-5)


# --- recall --------------------------------------------------------------------------------------------------------


def test_near_duplicates_of_075_to_085_are_found(spark):
    rng = random.Random(6)
    rows, wanted = [], 0
    for i in range(300):
        words = text(120, rng).split()
        other = list(words)
        for p in rng.sample(range(5, 115), rng.choice([2, 3])):
            other[p] = f"new{i}x{p}"
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        wanted += 0.75 <= len(a & b) / len(a | b) < 0.86
        assert len(a & b) / len(a | b) >= 0.75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert wanted >= 100 and sum(got[2 * i + 1] == 2 * i for i in range(300)) >= 0.99 * 300
    assert all(got[2 * i] == 2 * i for i in range(300))


@pytest.mark.parametrize("blocks", [1, 2])
def test_near_vectors_of_095_to_096_are_found(spark, blocks):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(400, 64))
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = rng.uniform(0.9502, 0.96, size=(400, 1))
    y = cos * x + np.sqrt(1 - cos**2) * u
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    tables = embedding_dedup.plan(embedding_dedup.ONE_BLOCK * (10 if blocks == 2 else 1))
    assert tables[1] == blocks
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=tables[0], blocks=blocks).collect()
    got = {r["vec_id"]: r for r in found}
    assert sum(got[400 + i]["component_id"] == i for i in range(400)) >= 0.99 * 400
    assert all(got[i]["n_links"] == (got[400 + i]["component_id"] == i) for i in range(400))


def test_large_cells_and_groups_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(10)
    base = rng.normal(size=64)
    near = [base + 0.05 * rng.normal(size=64) for _ in range(150)]
    far = [rng.normal(size=64) for _ in range(50)]
    rows = [(i, v.tolist()) for i, v in enumerate([*near, *far, far[0], far[0] * 3])] + [(1, far[1].tolist()), (None, None), (None, near[0].tolist())]
    x = [np.array(v) for _, v in rows if v]
    cos = np.array([[a @ b / math.sqrt((a @ a) * (b @ b)) for b in x] for a in x]) >= 0.95
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert collections.Counter(r["n_links"] for r in got) == collections.Counter([*(cos.sum(1) - 1).tolist(), 0])
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_vectors(empty).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


def first_fit_decreasing(lengths: list[int], capacity: int) -> int:
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        for i, used in enumerate(bins):
            if used + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


def test_bins_are_about_as_few_as_possible():
    """The method is a heuristic: a case may need a bin more than first fit decreasing does, all together 1 % more."""
    rng, total, other = random.Random(13), 0, 0
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        found = packing.patterns(dict(collections.Counter(lengths)), 64)
        used = collections.Counter()
        for bins, taken in found:
            assert sum(k * v for k, v in taken.items()) <= 64
            used.update({k: v * bins for k, v in taken.items()})
        assert used == collections.Counter(lengths)
        n = sum(bins for bins, _ in found)
        assert -(-sum(lengths) // 64) <= n <= first_fit_decreasing(lengths, 64) + 1
        total, other = total + n, other + first_fit_decreasing(lengths, 64)
    assert total <= 1.01 * other


def test_pieces_equal_the_library(spark):
    rng = random.Random(14)
    rows = [(1, text(3000, rng)), (2, None), (3, ""), (4, "a  b\n\nc " + text(20, rng)), (None, "x"), (1, "again")]
    whole = encode.Encoder(encode.vocabulary())._whole
    want = collections.Counter()
    for k, t in rows:
        raw = whole(t or "") + b"\0\0\0\0"
        n = len(raw) // 4
        cuts = [0, *range(n % 2048 or min(n, 2048), n + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(k, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))] += 1
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


# --- nulls, repeated rows, clashing names -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, nulls in all columns, and columns named as the operators' own."""
    line = text(40)
    rows = [(1, line), (1, line), (2, None), (None, line + " end"), (None, None), (3, ""), (4, text(300)), (5, line.upper())]
    names = ["_k", "_text", "_kept", "_again", "k", "text_hash", "turn", "kept_text", "row", "chunk", "hilbert", "_dimension0", "_body", "body", "_salt_k", "shard", "_slot"]
    out = [(i, t, None if n % 3 == 0 else "en", None if n % 2 else "s", n, *[f"{c}{n}" for c in names]) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))


def test_columns_survive(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, text(20)), (None, None)], "item_id long, text string")
    rows = {tuple(r[5:]): r for r in odd.collect()}
    for out, least in ((minhash_dedup.keep_first(odd), 5), (suffix_dedup.remove_repeats(odd), 8), (decontaminate.decontaminate(odd, items, longest=12), 8), (quality.keep_good(odd, labels, threshold=0.0), 8)):
        assert out.columns == odd.columns
        got = out.collect()
        assert len(got) >= least and all(tuple(r[5:]) in rows and r["doc_id"] == rows[tuple(r[5:])]["doc_id"] for r in got)
    path = common.scratch_path(spark, "odd-shards")
    sharding.write_shards(odd, path, 3)
    back = spark.read.parquet(path).select(*[c for c in odd.columns if c != "shard"])
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter(tuple(x for c, x in r.asDict().items() if c != "shard") for r in odd.collect())


def test_repeated_rows_and_empty_tables_keep_their_number(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, text(20))], "item_id long, text string")

    def stored(docs):
        path = common.scratch_path(spark, "odd-store")
        token_store.write_store(docs, path, TOKENIZER)
        return token_store.read_documents(spark, path)

    none = odd.limit(0)
    for f in (
        lambda d: decontaminate.contamination(d, items), lambda d: decontaminate.contamination(d, items.limit(0)), lambda d: toxicity.toxicity(d, labels), stored,
        minhash_dedup.near_duplicates, lambda d: ngram_lm.scores(d), lambda d: quality.quality_scores(d, labels), sharding.hilbert_shards, suffix_dedup.dedup_windows,
    ):
        assert f(odd).count() == 8 and f(none).count() == 0


# --- the pipeline --------------------------------------------------------------------------------------------------


def removed(rows: list[tuple], window: int = 100) -> dict:
    """Texts less their repeated windows; only whole characters go."""
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = True
            seen.add(b[i : i + window])
        out[k] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode()
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(15)
    line, items = text(40, rng), [(i, text(20, rng)) for i in range(3)]
    rows = [(i, text(rng.randint(20, 120), rng) + ".") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(".", " indeed.")) for i in range(10)] + [(120 + i, rows[i][1]) for i in range(5)]
    rows += [(200 + i, text(30, rng) + "\n" + line + "\n" + text(30, rng)) for i in range(6)]
    rows += [(300, text(10, rng) + " " + items[0][1]), (301, text(900, rng) + " " + items[1][1] + " " + text(20, rng)), (302, "")]
    rows += [(400 + i, "$$ " + " !! ".join(text(2, rng).upper() for _ in range(12))) for i in range(60)]
    marks = [(k, int(k < 400), 0) for k, _ in rows if k % 3 or k >= 400]
    folder = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        stages[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = {n: {r["doc_id"]: r["text"] for r in stages[n].collect()} for n in ("quality", "near_duplicates", "repeats", "benchmark")}
    # quality: what the scores say
    scored = quality.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(kept["quality"]) == {r["doc_id"] for r in scored.collect() if r["predicted"]} and len(kept["quality"]) < len(rows)
    # near duplicates: the first of each group
    sets = {}
    for k, t in kept["quality"].items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    assert set(kept["near_duplicates"]) == {k for k in up if up[k] == k} and len(kept["near_duplicates"]) <= len(kept["quality"]) - 15
    # repeats, benchmark
    assert kept["repeats"] == removed(list(kept["near_duplicates"].items()))
    assert sum(line in t for t in kept["repeats"].values()) == 1
    clean = {}
    for k, t in kept["repeats"].items():
        w, hit = decontaminate.words_of(t.encode()), set()
        for _, item in items:
            x = decontaminate.words_of(item.encode())
            for j in range(len(x) - 12):
                for i in range(len(w) - 12):
                    if w[i : i + 13] == x[j : j + 13]:
                        hit |= {*range(i, i + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean[k] = [x for i, x in enumerate(w) if i not in hit]
    assert {k: decontaminate.words_of(t.encode()) for k, t in kept["benchmark"].items()} == clean and 300 not in clean and 301 in clean
    # packing: all that is left, and the whole again by run()
    pieces = stages["packing"].collect()
    assert {r["doc_id"] for r in pieces} == set(clean)
    digest = lambda rs: hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)).encode()).hexdigest()
    assert digest(pieces) == digest(pipeline.run(spark, folder).collect())
