"""The prefix trie, the balanced mix and the infilling format against brute force, with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scenelake.llm import balanced_mix, common, infilling, prefix_trie

CONV = "conv_id long, turn long, role string, text string, c string, node int, pos int, size int"
DOCS = "doc_id long, text string, source string, s int, k string, rank int, p double, h int, n int, form int, output int"


def conversations() -> list[tuple]:
    rng, rows = random.Random(5), []
    words = ["a", "b b", "c\tc  c", "", None, "d d é", "long " * 40]
    for c in [*range(-3, 48), 60, 61, 62, 63, 201, 202, 203, 204, 205, 206]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 9, 17])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(words[:3]) if t < 3 else rng.choice(words)))
    rows += [(400 + i, t, "user", "same" if t < 30 else f"end {i % 2}") for i in range(6) for t in range(31)]  # long, alike
    rows += [(None, 1, "user", "a"), (None, None, "user", "b b"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    return rows


def brute_trie(rows: list[tuple]) -> dict:
    def digest(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()

    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        by[c].append(((turn is not None, turn or 0, role, digest(role, text)), (role, text, words)))
    own = {c: [x[1] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 4
        base = c if c is None else c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    order = lambda c: -(2**63) if c is None else c
    members = collections.defaultdict(list)
    for c in sorted(built, key=order):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * p[-1][2] if p else 0
    out = {}
    for p, m in members.items():
        ends = ",".join("" if c is None else str(c) for c in m if len(built[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out[m[0], len(p)] = (parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("width", "long", "piece"), [(8, 1024, 1000), (2, 3, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, width, long, piece):
    """Also with blocks and runs so small that conversations go on over many, and with keys dealt to many tasks."""
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "LONG", long)
    if width == 2:
        monkeypatch.setattr(common, "TASK_ROWS", 2)
        monkeypatch.setattr(common, "SALTS", 4)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], CONV).repartition(5)
    got = prefix_trie.prefix_trie(df).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    want = brute_trie(rows)
    assert any(c not in {r[0] for r in rows if r[0] is not None and r[0] % 20 == 0} for c in (204,))
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.prefix_trie(empty).collect() == []
    assert prefix_trie.prefix_trie(empty).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_flight_keeps_both_sums_and_the_probabilities():
    rng = np.random.default_rng(3)
    size = np.r_[rng.integers(0, 50, 200), np.zeros(20, int), np.full(30, 7)]
    p, seen = rng.uniform(0.01, 0.99, len(size)), np.zeros(len(size))
    for i in range(300):
        q = balanced_mix.flight(size, p, rng.integers(0, 2**63, len(size)).astype(np.uint64))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-5
        seen += q
    assert np.abs(seen / 300 - p).max() < 0.15 and np.abs(seen / 300 - p).mean() < 0.04


def test_landing_takes_the_best_combination():
    size, p = np.array([5, 3, 9, 4]), np.array([0.5, 1.0, 0.25, 0.5])
    q = balanced_mix.landing(size, p)
    assert set(q) <= {0.0, 1.0} and q[1] == 1 and abs(q @ size - p @ size) <= 2.75
    with pytest.raises(ValueError):
        balanced_mix.landing(np.ones(17), np.full(17, 0.5))


def targets_by_loop(totals: dict) -> dict:
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, capped = sum(totals.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        share = (full - sum(3 * totals[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * share > 3 * totals[s]}
        if not over:
            return {s: 3 * totals[s] if s in capped else weight[s] * share for s in order}
        capped |= over


def test_mix_meets_its_targets_on_any_partitioning(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for s, n in (("a", 700), ("B", 60), ("é", 9), (None, 25), ("tiny", 2), ("", 30), ("𐀀", 12), ("～", 12), ("none", 3)):
        rows += [(len(rows) + i, None if s == "none" else "w " * int(rng.paretovariate(1.1) * 3 % 400), s) for i in range(n)]
    rows += [(None, "x y z", "a"), (None, "x y z", "a"), (3, "x", "a"), (705, "", "B")]
    extra = (1, "k", 2, 0.5, 3, 4, 5, 6)
    df = spark.createDataFrame([(*r, *extra) for r in rows], DOCS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, largest = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        totals[s] += words(t)
        largest[s] = max(largest[s], words(t))
    want = targets_by_loop(totals)
    monkeypatch.setattr(common, "TASK_ROWS", 5)
    runs = []
    for parts in (3, 11):
        got = balanced_mix.copies(df.repartition(parts), group=128)
        runs.append(sorted(map(tuple, got.collect()), key=str))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    source = {r[0]: r[2] for r in rows}
    taken = collections.Counter()
    for doc_id, size, source_size, target, copies in runs[0]:
        s = "a" if doc_id is None else source[doc_id]
        assert target == pytest.approx(want[s], rel=1e-9) and source_size == totals[s] and 0 <= copies <= 3
        whole = int(want[s] / totals[s] + 1e-9) if totals[s] else 0
        assert copies - whole in (0, 1)
        taken[s] += size * copies
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(1, 0.6 * largest[s]), s
    assert abs(taken["a"] - want["a"]) < 0.1 * want["a"]


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert balanced_mix.mix(empty).collect() == []
    got = balanced_mix.mix(spark.createDataFrame([(1, None, None, *[None] * 8), (2, " ", "x", *[None] * 8)], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_infilling_equals_plain_loops(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "one", "\t a\n\n", "a\x0b\x0c\r b\x1cc　d é𐀀", "x <P> y z", "a<S>b", "<M>", "a <", "P> S> M>", "<P <S <M < <"]
    texts += ["".join(rng.choice(["a", "bé ", " ", "\n", "𐀀", "<", "P>", "S", "x y "]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["word  " * 300_000]
    rows = [(i if i != 20 else None, t) for i, t in enumerate(texts)] + [(25, "again  and again"), (25, "again  and again")]
    df = spark.createDataFrame([(*r, "s", 1, "k", 2, 0.5, 3, 4, 5, 6) for r in rows], DOCS)
    made = infilling.fill_in_middle(df)
    got = made.withColumn("back", infilling.restored(made.output, made.form)).collect()
    want = []
    for k, t in rows:
        t, at, ends = t or "", 0, []
        while at < len(t):
            m = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+").match(t, at)
            at = m.end()
            ends.append(at)
        h = [int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
        a, b = (ends[i - 1] if i else 0 for i in (a, b))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            want.append((k, len(ends), "plain", None, None, t, t))
        elif h[3] % 100 < 80:
            want.append((k, len(ends), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t))
        else:
            want.append((k, len(ends), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_infilling_of_nothing(spark):
    assert infilling.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
