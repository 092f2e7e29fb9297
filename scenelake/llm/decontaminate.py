"""Benchmark decontamination with generalised suffix automata of the normalised test items.

An automaton holds every run of words of its items; a document's words are streamed through it, which yields at each
word the longest run of item words that ends there. Items are cut into segments of a bounded number of words, which
overlap by a window less one word, and are dealt by hash to shards of a bounded size. Tasks build one automaton a shard
and write it as flat sorted arrays to the shared folder, along with an index from hashes of all windows to shards.
Neither passes through the driver.

Documents are read once. A document's windows are looked up in the mapped index, all at once; only the stretches that
it names, and only those shards' automata, are mapped and walked. Hardly any text of a clean document is walked at all,
and how many shards there are does not change what a document costs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import Mapped, WordHashes, bounded_batches, keyed_texts, mapped_arrays, mixed, partitions, scratch_path, slices, span_hashes, unkey, write_arrays

#: Bytes of item text in a shard, about; an automaton of so much text has some 200,000 states in 12 MB.
SHARD_BYTES = 1 << 20
#: Words of a segment of an item.
SEGMENT = 50_000
#: Hashes in a file of the index, about.
INDEX_ROWS = 4_000_000
#: Automata that a worker keeps mapped.
OPEN_SHARDS = 64
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)  # A-Z become a-z; all but digits, letters and bytes from 0x80 on become blanks


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_FOLD).split()


def _window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    return mixed(span_hashes(mixed(h), width) + np.uint64(width))


class Builder:
    """Generalised suffix automaton over word numbers, as lists while it grows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        new = self._state({}, 0, self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, arcs: dict[int, int], link: int, length: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy


def flat_automaton(segments: list[tuple[str, bool, list[bytes]]], window: int) -> dict[str, np.ndarray]:
    """Arrays of the automaton of segments (item, whether it is a whole short item, words).

    words: sorted hashes, a word's number being its place. arcs, target: (state << 32 | word) sorted, and where it
    leads. link, length: of states. at_window: the state of the last ``window`` words of a match. item_of, item_at,
    item_to: items that hold the window of a state. short, short_up, short_at, short_to, short_len: short items that
    end at a state, and the next shorter state that has any. name, name_to: item ids, joined, and their ends.
    """
    hashes = WordHashes()
    known, numbered = np.unique(hashes.of([w for *_, ws in segments for w in ws]), return_inverse=True)
    ends = np.cumsum([len(ws) for *_, ws in segments])
    texts = [x.tolist() for x in np.split(numbered, ends[:-1])] if segments else []
    names = sorted({n for n, *_ in segments})
    number = {n: i for i, n in enumerate(names)}
    made = Builder()
    for ws in texts:
        made.add(ws)
    n, link, length = len(made.next), made.link, made.len
    order = sorted(range(n), key=length.__getitem__)
    at_window = [-1] * n
    for s in order:
        if length[s] >= window:
            at_window[s] = at_window[link[s]] if length[link[s]] >= window else s
    items, short = set(), set()
    for (name, whole, _), ws in zip(segments, texts, strict=True):
        s = 0
        for w in ws:
            s = made.next[s][w]
            if length[s] >= window:  # the prefix that ends here; its last words are a window of the item
                items.add((at_window[s], number[name]))
        if whole and ws:
            short.add((s, len(ws), number[name]))
    ends_here, up = {s for s, *_ in short}, [0] * n
    for s in order[1:]:
        up[s] = s if s in ends_here else up[link[s]]
    arcs = np.array(sorted((s << 32 | w, t) for s, out in enumerate(made.next) for w, t in out.items()) or np.zeros((0, 2)), np.int64).reshape(-1, 2)
    items = np.array(sorted(items) or np.zeros((0, 2)), np.int64).reshape(-1, 2)
    short = np.array(sorted(short) or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    raw = [x.encode() for x in names]
    return {
        "words": known, "arcs": arcs[:, 0].copy(), "target": arcs[:, 1].astype("<i4"), "link": np.array(link, "<i4"), "length": np.array(length, "<i4"),
        "at_window": np.array(at_window, "<i4"), "item_at": items[:, 0].astype("<i4"), "item": items[:, 1].astype("<i4"), "short_up": np.array(up, "<i4"),
        "short_at": short[:, 0].astype("<i4"), "short_length": short[:, 1].astype("<i4"), "short_item": short[:, 2].astype("<i4"),
        "name": np.frombuffer(b"".join(raw), np.uint8), "name_to": np.cumsum([len(x) for x in raw]).astype("<i8"),
    }


class Automaton:
    """Walks words through the flat arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int):
        self.window, self.words, self.name = window, arrays["words"], arrays["name"]
        for n in ("arcs", "target", "link", "length", "at_window", "item_at", "item", "short_up", "short_at", "short_length", "short_item", "name_to"):
            setattr(self, n, memoryview(arrays[n]))

    def _rows(self, keys: memoryview, values: memoryview, s: int) -> list[int]:
        out, i = [], bisect_left(keys, s)
        while i < len(keys) and keys[i] == s:
            out.append(i if values is None else values[i])
            i += 1
        return out

    def item_name(self, i: int) -> str:
        return bytes(self.name[self.name_to[i - 1] if i else 0 : self.name_to[i]]).decode()

    def match(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int], int]:
        """Runs (start, stop) of words inside windows, the items that these belong to, the longest match of all."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        spans, found, longest, s, n = [], set(), 0, 0, 0
        for i, w in enumerate(np.where(self.words[at] == hashes, at, -1).tolist(), 1):
            if w < 0:
                s = n = 0
                continue
            while True:
                a = bisect_left(self.arcs, s << 32 | w)
                if a < len(self.arcs) and self.arcs[a] == s << 32 | w:
                    s, n = self.target[a], n + 1
                    break
                if not s:
                    n = 0
                    break
                s = self.link[s]
                n = self.length[s]
            longest = max(longest, n)
            if n >= self.window:
                spans.append((i - self.window, i))
                found.update(self._rows(self.item_at, self.item, self.at_window[s]))
            up = self.short_up[s]
            while up:
                for r in self._rows(self.short_at, None, up):
                    if self.short_length[r] <= n:
                        spans.append((i - self.short_length[r], i))
                        found.add(self.short_item[r])
                up = self.short_up[self.link[up]]
        return spans, found, longest


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Model:
    """Where the automata and the index are; matching maps what it needs."""

    def __init__(self, uri: str, window: int, short: list[int], bits: int):
        self.uri, self.window, self.short, self.bits = uri, window, short, bits
        self.index = Mapped(uri, "index-{:05d}")
        self.open: dict[int, Automaton] = {}

    def _shard(self, i: int) -> Automaton:
        if i not in self.open:
            if len(self.open) >= OPEN_SHARDS:
                self.open.pop(next(iter(self.open)))
            self.open[i] = Automaton(mapped_arrays(self.uri, f"automaton-{i:06d}"), self.window)
        return self.open[i]

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in hashes, shard) of the hashes that are in the index."""
        places, shards = [], []
        files = (hashes >> np.uint64(1) >> np.uint64(63 - self.bits)).astype(np.int64)
        for b in np.unique(files).tolist():
            if found := self.index[b]:
                keys, shard = found["hash"], found["shard"]
                own = np.flatnonzero(files == b) if self.bits else np.arange(len(hashes))
                at = np.searchsorted(keys, hashes[own])
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == hashes[own])
                for i, a in zip(own[hit].tolist(), at[hit].tolist(), strict=True):
                    while a < len(keys) and keys[a] == hashes[i]:
                        places.append(i)
                        shards.append(int(shard[a]))
                        a += 1
        return np.array(places, np.int64), np.array(shards, np.int64)

    def match(self, bodies: list[bytes], known: WordHashes) -> list[tuple[int, list[tuple[int, int]], set[str], int]]:
        """Number of words, maximal runs of hit words, items and longest match of each text."""
        lists = [words_of(b) for b in bodies]
        ends = np.cumsum([len(x) for x in lists])
        h = known.of([w for x in lists for w in x])
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for width in sorted({self.window, *self.short}):
            places, shards = self._found(_window_hashes(h, width))
            docs = np.searchsorted(ends, places, side="right")
            for p, shard, d in zip(places.tolist(), shards.tolist(), docs.tolist(), strict=True):
                if p + width <= ends[d]:  # within one text
                    wanted.setdefault((d, shard), []).append((p, p + width))
        out = [(len(x), [], set(), 0) for x in lists]
        for (d, shard), stretches in sorted(wanted.items()):
            start, (n, spans, names, longest) = int(ends[d]) - len(lists[d]), out[d]
            automaton = self._shard(shard)
            for a, b in joined(stretches):
                hit, items, most = automaton.match(h[a:b])
                spans = spans + [(a - start + x, a - start + y) for x, y in hit]
                names, longest = names | {automaton.item_name(i) for i in items}, max(longest, most)
            out[d] = (n, joined(spans), names, longest)
        return out


def build(benchmark: DataFrame, window: int = 13, shard_bytes: int = SHARD_BYTES) -> Model:
    """Builds automata and index in the shared folder. Items without words have no window; null ids are named ""."""
    spark = benchmark.sparkSession
    uri = scratch_path(spark, "automata")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    size = int(items.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    shards = 1 + size // shard_bytes
    bits = max(0, (size // 4 // INDEX_ROWS).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, whole, texts = [], [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                for at in range(0, max(1, len(words) - window + 1), SEGMENT) if words else ():
                    names.append(name)
                    whole.append(len(words) < window)
                    texts.append(b" ".join(words[at : at + SEGMENT + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(whole, pa.bool_()), pa.array(texts, pa.binary())], names=["name", "whole", "words"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard: int, held: list) -> Iterator[pa.RecordBatch]:
            write_arrays(uri, f"automaton-{shard:06d}", flat_automaton(held, window))
            known = WordHashes()
            for _, is_short, words in held:
                width = len(words) if is_short else window
                found = np.unique(_window_hashes(known.of(words), width))
                file = (found >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)
                columns = [pa.array(file), pa.array(found.view(np.int64)), pa.array(np.full(len(found), shard, np.int64)), pa.array(np.full(len(found), width if is_short else 0, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "hash", "shard", "short"])

        last, held = None, []
        for batch in batches:
            for shard, name, is_short, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and shard != last:
                    yield from made(last, held)
                    held = []
                last = shard
                held.append((name, is_short, text.split(b" ")))
        if held:
            yield from made(last, held)

    def write_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def made() -> pa.RecordBatch:
            h, shard = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.lexsort((shard, h.view(np.uint64)))
            write_arrays(uri, f"index-{last:05d}", {"hash": h.view(np.uint64)[order], "shard": shard[order].astype("<u4")})
            return pa.RecordBatch.from_arrays([pa.array([len(h)])], names=["rows"])

        for batch in batches:
            file, h, shard = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and int(file[a]) != last:
                        yield made()
                        held = []
                    last = int(file[a])
                    held.append((h[a:b], shard[a:b]))
        if held:
            yield made()

    segments = items.mapInArrow(cut, "name string, whole boolean, words binary").withColumn("shard", F.pmod(F.xxhash64("words", "name"), F.lit(shards)))
    dealt = segments.select("shard", "name", "whole", "words").repartition(min(shards, 10 * partitions(spark)), "shard").sortWithinPartitions("shard", "name", "words")
    rows = dealt.mapInArrow(write, "file long, hash long, shard long, short int")
    path = f"{uri}/windows"
    rows.write.parquet(path)
    rows = spark.read.schema("file long, hash long, shard long, short int").parquet(path)
    short = sorted(r[0] for r in rows.where("short > 0").select("short").distinct().collect())  # fewer than ``window``
    index = rows.select("file", "hash", "shard").distinct().repartition("file").sortWithinPartitions("file")
    index.mapInArrow(write_index, "rows long").agg(F.sum("rows")).collect()
    return Model(uri, window, short, bits)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, starts, stops for each document.

    Words are runs of digits, letters (A-Z folded) and non-ASCII characters. Windows are ``window`` consecutive words
    of an item, or all words of a shorter one; items without words have none. A word within an occurrence of a window
    is hit; n_items are the items (by id) whose windows occur. Contaminated: some word is hit, and at least
    ``percent`` of them are. longest is the longest run of an item's words within what is hit (within one segment and
    one shard); starts and stops are the maximal runs of hit words. Null and empty texts have no words; every row is
    returned, whatever its id, and rows that repeat an id are judged one by one; without items nothing is hit.
    """
    bounded_batches(docs.sparkSession)
    model = build(benchmark, window, shard_bytes)
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "longest": pa.int64(), "starts": pa.list_(pa.int64()), "stops": pa.list_(pa.int64())}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for some in slices(batch):
                rows = []
                for n, spans, names, longest in model.match(some.column(1).to_pylist(), known):
                    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                    rows.append((n, sum(b - a for a, b in spans), len(names), digest, longest, [a for a, _ in spans], [b for _, b in spans]))
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]], names=["k", *kinds])

    found = keyed_texts(docs).mapInArrow(find, "k long, n_words long, n_hit long, n_items long, items_sha256 string, longest long, starts array<long>, stops array<long>")
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    return found.select(unkey("k").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "longest", "starts", "stops")


def without_spans(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its words from start to stop of each span, nor what stands between these words."""
    import re

    places = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", body.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(body[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + body[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, longest: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, all columns, that are not contaminated, in one pass without a shuffle; each row for itself.

    With ``longest``, runs of more than so many hit words are also cut from the texts that stay, and n_chars, where
    there is such a column, follows. Null and empty texts stay.
    """
    bounded_batches(docs.sparkSession)
    model, at, schema = build(benchmark, window, shard_bytes), docs.columns.index("text"), docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = model.match([(t or "").encode() for t in texts], known)
            ok, cut = [], {}
            for i, (n, spans, _, _) in enumerate(found):
                hit = sum(b - a for a, b in spans)
                ok.append(not (hit and 100 * hit >= percent * n))
                gone = [s for s in spans if longest is not None and s[1] - s[0] > longest]
                if gone and ok[-1]:
                    cut[i] = without_spans(texts[i].encode(), gone).decode()
            columns = list(batch.columns)
            if cut:
                columns[at] = pa.array([cut.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if "n_chars" in schema.names:
                    c = schema.names.index("n_chars")
                    columns[c] = pa.array([len(cut[i]) if i in cut else x for i, x in enumerate(columns[c].to_pylist())], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, schema)
