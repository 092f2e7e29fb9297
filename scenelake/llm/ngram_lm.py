"""Interpolated modified Kneser-Ney language model, counted in Spark and read as mapped sorted arrays of hashes.

A model is a folder of files of plain little-endian arrays, each file a range of hashes:

* ``word-B``: sorted 64-bit hashes of the training tokens, their counts and their numbers: 0 for the most frequent word,
  then 1 and so on, so that blocks of grams, which are sorted by the numbers in them, compress well.
* ``top-B`` (order 3): sorted hashes of word triples, 48 bits each, and how often each occurs; B is a range of the
  hashes of their first two words, so all that follows a context is in one file.
* ``context-B`` (order 3): for the contexts that occur more than once, how often, and how many words follow them once,
  twice and more often. A context that occurs once needs no row: its pair is known, and one word follows it once.
* ``pair-B``: sorted hashes of word pairs and their counts: how many words stand before the pair (order 3), or how often
  it occurs (order 2).
* ``stat-B``: for each word the same about the pairs that it begins, and how many words stand before it.

Texts are read twice: to count words, and to turn them into word numbers, which are stored. Counting then is a shuffle
of blocks of sorted grams for each order and one of word statistics; tasks add up what they can before. Words are known
by 64-bit hashes, pairs are counted exactly, and files keep 48 bits of the hashes of pairs and triples. Counts have no upper limit:
those of 255 and more stand in lists of their own. Workers map the files, so a machine's workers share the pages.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import NULL_ID, Mapped, WordHashes, bounded_batches, keyed_texts, mixed, partitions, ranked, remainder, remove, saved, scratch_path, slices, stable_order, unkey, write_arrays

#: Tokens that a task holds before it adds up their grams, and that a file holds about.
HELD = 3_000_000
#: Words in a block of statistics.
BLOCK = 1 << 18
END = b"\n"  # no word holds a line feed
#: The number of a word that training has not seen.
UNKNOWN = 2**32 - 1
_C = 0xD1342543DE82EF95
_KINDS = ("n1", "n2", "n3", "total")


def _power(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _file(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, number of each key among them)."""
    order = stable_order(keys)
    in_order = keys[order]
    new = np.r_[True, in_order[1:] != in_order[:-1]] if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return in_order[new], number


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = stable_order(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, compressed; the first array is sorted and stored as differences."""
    parts = [np.diff(arrays[0], prepend=np.uint64(0)).astype("<u8"), *(np.asarray(a).astype("<u8") for a in arrays[1:])]
    head = np.array([len(parts), *(len(a) for a in parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in parts))


def _loosened(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8).tolist(), 8 + 8 * n, []
    for size in sizes:
        out.append(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T.copy().view("<u8").reshape(-1))
        at += 8 * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _counted(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; 255 stands for what is listed apart."""
    big = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": big.astype("<u4"), f"{name}_big": counts[big].astype("<u8")}


def _counts(arrays: dict[str, np.ndarray], name: str, places: np.ndarray) -> np.ndarray:
    out = arrays[name][places].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = arrays[f"{name}_big"][np.searchsorted(arrays[f"{name}_at"], places[big])]
    return out


def _keys48(composite: np.ndarray) -> dict[str, np.ndarray]:
    return {"high": (composite >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype("<u4"), "low": (composite & np.uint64(0xFFFF)).astype("<u2")}


class Grams:
    """Sorted 48-bit hashes with counts in files; a key is its file's number and 48 bits behind it."""

    def __init__(self, uri: str, kind: str, names: tuple[str, ...]):
        self.uri, self.kind, self.names = uri, kind, names
        self.open = Mapped(uri, f"{kind}-{{:05d}}")

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """Counts, 0 where there is none, of keys in ascending order."""
        out = {n: np.zeros(len(keys), np.int64) for n in self.names}
        files = (keys >> np.uint64(48)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(files)) + 1, len(files)]
        for a, b in itertools.pairwise(cuts.tolist()):
            if a == b:
                continue
            have = self.open[int(files[a])]
            if not have or not len(have["high"]):
                continue
            wanted = _keys48(keys[a:b])
            at, place, last = np.searchsorted(have["high"], wanted["high"]), np.full(b - a, -1, np.int64), len(have["high"]) - 1
            going = np.arange(b - a)
            while len(going):  # leading halves that agree are few
                here = np.minimum(at[going], last)
                same = (have["high"][here] == wanted["high"][going]) & (at[going] <= last)
                hit = same & (have["low"][here] == wanted["low"][going])
                place[going[hit]] = here[hit]
                going = going[same & ~hit]
                at[going] += 1
            found = np.flatnonzero(place >= 0)
            for n in self.names:
                out[n][a + found] = _counts(have, n, place[found])
        return out


class Vocabulary:
    """Numbers and counts of words by their hashes."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits = uri, bits
        self.open = Mapped(uri, "word-{:05d}")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or UNKNOWN, count or 0) of hashes in any order."""
        unique, back = _unique(hashes)
        number, count = np.full(len(unique), UNKNOWN, np.int64), np.zeros(len(unique), np.int64)
        files = _file(unique, self.bits)
        for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]):
            if a == b:
                continue
            if found := self.open[int(files[a])]:
                have = found["hash"]
                at = np.minimum(np.searchsorted(have, unique[a:b]), len(have) - 1)
                hit = np.flatnonzero(have[at] == unique[a:b])
                number[a + hit], count[a + hit] = found["number"][at[hit]], found["count"][at[hit]]
        return number[back], count[back]


def _token_hashes(bodies: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and how many each text has."""
    lists = [b.lower().split() for b in bodies]
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    return known.of(list(itertools.chain.from_iterable((*x, END) for x in lists))), sizes


def _before(numbers: np.ndarray, sizes: np.ndarray, start: int, steps: int) -> np.ndarray:
    """The number so many steps before each token of its text, ``start`` before the first."""
    out = np.full(len(numbers), start, np.uint64)
    out[steps:] = numbers[: max(0, len(numbers) - steps)]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    for i in range(steps):
        out[(first + i)[i < sizes]] = start
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << np.uint64(32) | b


def _triples(context: np.ndarray, numbers: np.ndarray, bits: int) -> np.ndarray:
    """Keys of triples, from the mixed pair before and a word: the file of the pair, and 48 bits of a hash of all three."""
    h = mixed(context * np.uint64(_C) + numbers)
    return _file(context, bits).astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)


#: Tasks that add up the statistics of one block of words.
STAT_PARTS = 32


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows of each bucket (first column), which must come together: columns as lists."""
    last, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != last:
                if held:
                    yield last, [list(c) for c in zip(*held, strict=True)]
                last, held = row[0], []
            held.append(row)
    if held:
        yield last, [list(c) for c in zip(*held, strict=True)]


def _dealt(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): pairs by their file, those of a file in the order they had; and where files begin and end."""
    files = _file(mixed(pairs), bits).astype(np.uint16)
    order = np.argsort(files, kind="stable")
    return order, np.r_[0, np.flatnonzero(np.diff(files[order].astype(np.int64))) + 1, len(pairs)]


def _blobs(pairs: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(b, blob) of sorted pairs and their counts, by file."""
    order, cuts = _dealt(pairs, bits)
    pairs, counts = pairs[order], counts[order]
    for a, b in itertools.pairwise(cuts.tolist()):
        if b > a:
            yield pa.RecordBatch.from_arrays([_file(mixed(pairs[a : a + 1]), bits), pa.array([_squeezed(pairs[a:b], counts[a:b])], pa.binary())], names=["b", "blob"])


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2) and D(3 or more) from how many grams have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]])


class Model:
    """What the driver and the closures know of a model: a few numbers and the sizes of its files."""

    def __init__(self, uri: str, order: int):
        self.uri, self.order = uri, order


def _sums(rows: DataFrame, names: list[str]) -> dict[str, int]:
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict()


def _count_words(bodies: DataFrame, model: Model) -> None:
    """Writes the word files and sets word_bits, n_words and n_tokens, and bits, which make as many files of grams."""
    bits, uri = min(16, _power(partitions(bodies.sparkSession))), model.uri

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = WordHashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            keys, counts = h[first], np.diff(np.r_[first, len(h)])
            for i in range(0, len(keys), 100_000):
                some = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(_file(some, bits)), pa.array(some.view(np.int64)), pa.array(counts[i : i + 100_000])], names=["b", "h", "n"])

        for batch in batches:
            for some in slices(batch):
                hashes, _ = _token_hashes(some.column(1).to_pylist(), known)
                held.append(hashes)
                n += len(hashes)
                if n >= 2 * HELD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: int, held: list) -> pa.RecordBatch:
            h, n, number = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            order = np.argsort(h.view(np.uint64))
            write_arrays(uri, f"word-{b:05d}", {"hash": h.view("<u8")[order], "count": n.astype("<u8")[order], "number": number.astype("<u4")[order]})
            return pa.RecordBatch.from_arrays([pa.array([len(h)]), pa.array([int(n.sum())])], names=["words", "tokens"])

        last, held = None, []
        for batch in batches:
            b, *columns = (c.to_numpy() for c in batch.columns)
            for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]):
                if j > i:
                    if held and b[i] != last:
                        yield made(last, held)
                        held = []
                    last = int(b[i])
                    held.append([c[i:j] for c in columns])
        if held:
            yield made(last, held)

    words, words_path = saved(bodies.mapInArrow(count, "b long, h long, n long").groupBy("b", "h").agg(F.sum("n").alias("n")), "words")
    numbers, numbers_path = ranked(words.withColumn("less", -F.col("n")), "less", "h", name="words-ranked")
    dealt = numbers.select("b", "h", "n", "rank").repartition("b").sortWithinPartitions("b")
    made, made_path = saved(dealt.mapInArrow(write, "words long, tokens long"), "words-made")
    found = _sums(made, ["words", "tokens"])
    remove(bodies.sparkSession, words_path, numbers_path, made_path)
    model.word_bits, model.n_words, model.n_tokens = bits, found["words"], found["tokens"]
    if model.n_words >= UNKNOWN - 1:
        raise ValueError("the vocabulary needs wider numbers")
    model.bits = min(16, _power(model.n_tokens / HELD))


def _numbered(docs: DataFrame, model: Model, divisor: int, held: int) -> tuple[DataFrame, str]:
    """(k, held_out, n_tokens, n_known, base_score, numbers) of every document, stored; numbers are 32-bit, byte by byte."""
    uri, bits, n, v = model.uri, model.word_bits, model.n_tokens, model.n_words

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHashes(), Vocabulary(uri, bits)
        for batch in batches:
            for some in slices(batch):
                hashes, sizes = _token_hashes(some.column(1).to_pylist(), known)
                numbers, counts = table.find(hashes)
                first = np.r_[0, np.cumsum(sizes)[:-1]]
                raw, stops = numbers.astype("<u4").view(np.uint8).reshape(-1, 4), np.cumsum(sizes).tolist()
                lists = pa.array([raw[b - m : b].T.tobytes() for b, m in zip(stops, sizes.tolist(), strict=True)], pa.binary())
                total = lambda x: pa.array(np.add.reduceat(x, first))  # noqa: B023, E731
                base = np.log10((counts + 1.0) / (n + v + 1.0))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(sizes), total((counts > 0).astype(np.int64)), total(base), lists], names=["k", "held_out", "n_tokens", "n_known", "base_score", "numbers"])

    rows = keyed_texts(docs).withColumn("held_out", remainder_of_key(divisor) == held)
    return saved(rows.mapInArrow(number, "k long, held_out boolean, n_tokens long, n_known long, base_score double, numbers binary"), "numbers")


def remainder_of_key(divisor: int) -> Column:
    """remainder() of an id whose null is replaced."""
    return F.crc32(F.when(F.col("k") == NULL_ID, F.lit("")).otherwise(F.col("k").cast("string")).cast("binary")) % divisor


def _batches_of_numbers(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, numbers, sizes) of bounded parts of batches with a column of numbers."""
    for batch in batches:
        for some in slices(batch, batch.schema.names[at]):
            raw = some.column(at).to_pylist()
            flat = b"".join(np.frombuffer(r, np.uint8).reshape(4, -1).T.tobytes() for r in raw)
            yield some, np.frombuffer(flat, "<u4").astype(np.uint64), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def _write_top(rows: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """Counts triples and writes top and context files; returns (b, blob) of the pairs that end them, by pair."""
    uri, start, bits = model.uri, model.n_words, model.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            context, numbers = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            contexts, rank = _unique(context)
            order, cuts = _dealt(contexts, bits)
            contexts, place = contexts[order], np.empty(len(order), np.uint64)
            place[order] = np.arange(len(order), dtype=np.uint64)
            both = np.sort(place[rank] << np.uint64(32) | numbers)
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            counts, both = np.diff(np.r_[first, len(both)]), both[first]
            follow = np.searchsorted(both >> np.uint64(32), np.arange(len(contexts) + 1, dtype=np.uint64))
            for a, b in itertools.pairwise(cuts.tolist()):
                if b > a:
                    i, j = follow[a], follow[b]
                    blob = _squeezed(contexts[a:b], np.diff(follow[a : b + 1]), both[i:j] & np.uint64(0xFFFFFFFF), counts[i:j])
                    yield pa.RecordBatch.from_arrays([_file(mixed(contexts[a : a + 1]), bits), pa.array([blob], pa.binary())], names=["b", "blob"])

        for _, numbers, sizes in _batches_of_numbers(batches, 0):
            one, two = (_before(numbers, sizes, start, i) for i in (1, 2))
            held.append((_pairs(two, one), numbers))
            n += len(numbers)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, (_, blobs) in _by_bucket(batches):
            context, numbers, counts = [], [], []
            for keys, follow, w, c in map(_loosened, blobs):
                context.append(np.repeat(keys, follow.astype(np.int64)))
                numbers.append(w)
                counts.append(c)
            contexts, rank = _unique(np.concatenate(context))
            both, counts = _summed(rank.astype(np.uint64) << np.uint64(32) | np.concatenate(numbers), np.concatenate(counts))
            rank, numbers = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
            keys = _triples(mixed(contexts)[rank], numbers, bits)
            order = stable_order(keys)
            write_arrays(uri, f"top-{f:05d}", _keys48(keys[order]) | _counted("count", counts[order]))
            stats = {"total": np.bincount(rank, counts, len(contexts)).astype(np.int64)}
            stats |= {f"n{i}": np.bincount(rank, np.minimum(counts, 3) == i, len(contexts)).astype(np.int64) for i in (1, 2, 3)}
            last = contexts & np.uint64(0xFFFFFFFF)
            kept = np.flatnonzero((stats["total"] > 1) | (last == start))
            hashes = mixed(contexts[kept])
            order = stable_order(hashes)
            columns = {k: x for n in _KINDS for k, x in _counted(n, stats[n][kept][order]).items()}
            write_arrays(uri, f"context-{f:05d}", _keys48(_composite(hashes[order], bits)) | columns)
            made = [np.count_nonzero(counts == i) for i in (1, 2, 3, 4)]
            ends, times = _summed(_pairs(last[rank], numbers), np.ones(len(rank), np.int64))
            for i, row in enumerate(_blobs(ends, times, bits)):
                yield pa.RecordBatch.from_arrays([*row.columns, *[pa.array([0 if i else int(x)]) for x in made]], names=["b", "blob", "n1", "n2", "n3", "n4"])

    blobs = rows.select("numbers").mapInArrow(count, "b long, blob binary").repartition(1 << bits, "b").sortWithinPartitions("b")
    pairs, path = saved(blobs.mapInArrow(write, "b long, blob binary, n1 long, n2 long, n3 long, n4 long"), "pairs")
    found = _sums(pairs, ["n1", "n2", "n3", "n4"])
    model.top_discounts = discounts([found[f"n{i}"] for i in (1, 2, 3, 4)])
    return pairs.select("b", "blob"), [path]


def _composite(h: np.ndarray, bits: int) -> np.ndarray:
    """A hash's file and the 48 bits behind it."""
    return _file(h, bits).astype(np.uint64) << np.uint64(48) | (h << np.uint64(bits)) >> np.uint64(16)


def _raw_pairs(rows: DataFrame, model: Model) -> DataFrame:
    """(b, blob) of all pairs as they occur."""
    start, bits = model.n_words, model.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, numbers, sizes in _batches_of_numbers(batches, 0):
            held.append(_pairs(_before(numbers, sizes, start, 1), numbers))
            n += len(numbers)
            if n >= HELD:
                yield from _blobs(*_summed(np.concatenate(held), np.ones(n, np.int64)), bits)
                held, n = [], 0
        if held:
            yield from _blobs(*_summed(np.concatenate(held), np.ones(n, np.int64)), bits)

    return rows.select("numbers").mapInArrow(count, "b long, blob binary")


def _write_pairs(blobs: DataFrame, model: Model) -> None:
    """Writes pair and statistics files and sets the discounts of pairs and words."""
    uri, bits = model.uri, model.bits

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, (_, found) in _by_bucket(batches):
            parts = [_loosened(x) for x in found]
            keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            hashes = mixed(keys)
            order = stable_order(hashes)
            write_arrays(uri, f"pair-{f:05d}", _keys48(_composite(hashes[order], bits)) | _counted("count", counts[order]))
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # rows: number * 5 + what is counted: pairs that a word begins, seen once, twice, more, and their sum; pairs it ends
            rows, times = _summed(np.r_[first * 5 + np.minimum(counts, 3) - 1, first * 5 + 3, second * 5 + 4].astype(np.uint64), np.r_[np.ones(len(first), np.int64), counts, np.ones(len(first), np.int64)])
            block = (rows // np.uint64(5 * BLOCK)).astype(np.int64)
            made = [np.count_nonzero(counts == i) for i in (1, 2, 3, 4)]
            for i, (a, b) in enumerate(itertools.pairwise(np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)].tolist())):
                yield pa.RecordBatch.from_arrays([pa.array([int(block[a])]), pa.array([_squeezed(rows[a:b], times[a:b])], pa.binary()), *[pa.array([0 if i else int(x)]) for x in made]], names=["b", "stats", "n1", "n2", "n3", "n4"])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, its table, sums of the other columns), added up as rows come; a block's rows must come together."""
        last, table, sums = None, None, None
        for batch in batches:
            for b, blob, *counts in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("b", "stats", "n1", "n2", "n3", "n4")), strict=True):
                if b.as_py() != last:
                    if last is not None:
                        yield last, table, sums
                    last, table, sums = b.as_py(), np.zeros(5 * BLOCK, np.int64), np.zeros(4, np.int64)
                rows, times = _loosened(blob.as_py())
                table[rows.astype(np.int64) - 5 * BLOCK * last] += times.astype(np.int64)
                sums += [c.as_py() for c in counts]
        if last is not None:
            yield last, table, sums

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, table, sums in tables(batches):
            rows = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([_squeezed((rows + 5 * BLOCK * b).astype(np.uint64), table[rows])], pa.binary()), *[pa.array([int(x)]) for x in sums]], names=["b", "stats", "n1", "n2", "n3", "n4"])

    def write_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, table, sums in tables(batches):
            write_arrays(uri, f"stat-{b:05d}", {k: x for i, n in enumerate((*_KINDS, "ends")) for k, x in _counted(n, table[i::5]).items()})
            ends = table[4::5]
            numbers = [*sums.tolist(), int(ends.sum()), *(np.count_nonzero(ends == i) for i in (1, 2, 3, 4)), np.count_nonzero(ends >= 3)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in numbers], names=names)

    names = ["n1", "n2", "n3", "n4", "pairs", "e1", "e2", "e3", "e4", "e3_up"]
    pairs = blobs.repartition(1 << bits, "b").sortWithinPartitions("b")
    kind = "b long, stats binary, n1 long, n2 long, n3 long, n4 long"
    # the block of the most frequent words has rows from every pair file: they are added up by parts of the files first
    stats = pairs.mapInArrow(write, kind).withColumn("part", F.pmod(F.crc32("stats"), F.lit(STAT_PARTS)))
    stats = stats.repartition("b", "part").sortWithinPartitions("b", "part").mapInArrow(add_up, kind).repartition("b").sortWithinPartitions("b")
    stats, path = saved(stats.mapInArrow(write_stats, ", ".join(f"{n} long" for n in names)), "word-stats")
    found = _sums(stats, names)
    remove(blobs.sparkSession, path)
    model.pair_discounts = discounts([found[f"n{i}"] for i in (1, 2, 3, 4)])
    model.end_discounts = discounts([found[f"e{i}"] for i in (1, 2, 3, 4)])
    model.n_pairs, model.ends_left = found["pairs"], float(model.end_discounts[1:] @ np.array([found["e1"], found["e2"], found["e3_up"]], float))


def train(docs: DataFrame, divisor: int = 7, held: int = 2, order: int = 3) -> tuple[Model, DataFrame]:
    """A model of the documents whose remainder is not ``held``, in the shared folder, and the numbers of all documents.

    Null and empty texts are their end alone; rows that repeat an id count each for itself; no documents give a model
    that knows nothing.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    model = Model(scratch_path(spark, "ngram-model"), order)
    _count_words(keyed_texts(docs.where(remainder(divisor) != held)), model)
    numbered, _ = _numbered(docs, model, divisor, held)
    rows = numbered.where("not held_out")
    if order == 3:
        pairs, paths = _write_top(rows, model)
    else:
        pairs, paths = _raw_pairs(rows, model), []
    _write_pairs(pairs, model)
    remove(spark, *paths)
    return model, numbered


def _probabilities(model: Model, numbers: np.ndarray, sizes: np.ndarray, files: dict) -> np.ndarray:
    """The probability of each token after those before it in its text."""
    start, v, bits = model.n_words, model.n_words, model.bits
    one = _before(numbers, sizes, start, 1)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    pairs, number = _unique(_composite(mixed(_pairs(one, numbers)), bits))
    count = files["pair"].find(pairs)["count"][number]

    def of(name: str, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for b in np.unique(words[words < v] // np.uint64(BLOCK)).tolist() + ([v // BLOCK] if (words == v).any() else []):
            if stat := files["stat"][int(b)]:
                pick = np.flatnonzero((words // np.uint64(BLOCK) == b) & (words != UNKNOWN))
                out[pick] = _counts(stat, name, (words[pick] % np.uint64(BLOCK)).astype(np.int64))
        return out

    words, place = _unique(np.r_[one, numbers])
    before, here = place[: len(one)], place[len(one) :]
    left = sum(of(f"n{i}", words) * model.pair_discounts[i] for i in (1, 2, 3))[before]
    total, ends = of("total", words)[before], of("ends", words)[here]
    uniform = (model.ends_left / model.n_pairs if model.n_pairs else 1.0) / (v + 1)
    low = np.maximum(ends - model.end_discounts[np.minimum(ends, 3)], 0) / max(1, model.n_pairs) + uniform
    p = np.where(total > 0, (np.maximum(count - model.pair_discounts[np.minimum(count, 3)], 0) + left * low) / np.maximum(total, 1), low)
    if model.order == 2:
        return p
    # a token's context is the pair of the token before it, or two starts
    context = files["context"].find(pairs)
    seen = files["pair"].find(pairs)["count"] > 0
    alone = seen & (context["total"] == 0)
    context["n1"], context["total"] = context["n1"] + alone, context["total"] + alone
    starts = _composite(mixed(_pairs(np.array([start], np.uint64), np.array([start], np.uint64))), bits)
    begin = files["context"].find(starts)
    at = np.r_[0, number[:-1]]
    stats = {n: context[n][at] for n in _KINDS}
    for n in _KINDS:
        stats[n][first] = begin[n][0]
    keys, number = _unique(_triples(mixed(_pairs(_before(numbers, sizes, start, 2), one)), numbers, bits))
    count, d = files["top"].find(keys)["count"][number], model.top_discounts
    left = sum(stats[f"n{i}"] * d[i] for i in (1, 2, 3))
    return np.where(stats["total"] > 0, (np.maximum(count - d[np.minimum(count, 3)], 0) + left * p) / np.maximum(stats["total"], 1), p)


def scores(docs: DataFrame, divisor: int = 7, held: int = 2, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document.

    Tokens are the white-space words (A-Z folded) and one end. ``score`` is the log10 probability of the text under the
    interpolated modified Kneser-Ney model of ``order`` 2 or 3, unknown words sharing a uniform part; ``base_score``
    that of add-one counts. Null and empty texts have the end alone. Every row is returned, whatever its id; with
    nothing to learn from, known counts are 0 and the uniform part is all.
    """
    model, numbered = train(docs, divisor, held, order)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {k: Grams(model.uri, k, n) for k, n in (("pair", ("count",)), ("top", ("count",)), ("context", _KINDS))} | {"stat": Mapped(model.uri, "stat-{:05d}")}
        for some, numbers, sizes in _batches_of_numbers(batches, 5):
            p = _probabilities(model, numbers, sizes, files)
            total = np.add.reduceat(np.log10(np.maximum(p, 1e-300)), np.r_[0, np.cumsum(sizes)[:-1]])
            yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(total)], names=["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = numbered.mapInArrow(score, "k long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        unkey("k").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
