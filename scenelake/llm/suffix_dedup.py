"""Removal of repeated byte windows by a depth-limited radix sort of suffixes, most significant digit first.

Only the first ``window`` bytes of a suffix matter, so suffixes are sorted to that depth and no further: after the last
pass a group of equal suffixes is exactly one repeated window. The digits are the leading thirds of the window. A pass
extends the prefix by one digit: suffixes are dealt by a hash of their first 33, 66 and at last all 100 bytes, and what
is alone in its group is unique and leaves the sort with all that it could have become.

Texts are packed once, in the order of ids, into chunks of about 1 MiB, and a pass never moves a suffix: a chunk sends
the sorted distinct prefix hashes of its suffixes, as differences, to the tasks that own ranges of hashes, and gets one
bit for each back. So a passage counts once a chunk however often it stands there, no group is ever gathered, and a hot
passage brings its owner no more than one hash from each chunk.

1. Among suffixes that begin at places chosen by content (one in eight, by their own prefix hash, so all copies of a
   passage choose alike), prefixes of the first digit are sought that recur. A window in which a chosen suffix does not
   recur is unique. In the same pass whole texts that equal an earlier one are found: all their windows are repeats, and
   their suffixes leave the sort. What is left, a small part of most corpora, is copied into smaller chunks.
2. The chosen suffixes that are left, by their first two digits; windows in which one does not recur are unique.
3. All suffixes that are left, by the whole window: 64 bits of one hash and 16 of another. As chunks follow the order of
   ids, the lowest chunk that has a window has its first occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import bounded_batches, fresh, hashed_texts, key, mixed, partitions, remove, saved, stable_order, text_hash, unkey

#: Bytes of text in a chunk; a longer text is cut, its parts overlapping by a window less one byte.
CHUNK = 1 << 20
#: Hashes that an owner's task looks at together, about.
OWNED = 4_000_000
#: One suffix in 2**SAMPLE takes part in the first two passes.
SAMPLE = 3
_BYTES = np.random.default_rng(20240229).integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Prefixes:
    """Hashes of the first bytes of suffixes, to any depth, from sums over all bytes before each place."""

    def __init__(self, body: bytes, kind: int = 0):
        n = len(body)
        if len(_POWERS.get(kind, ((),))[0]) <= n:
            base, size = _BASES[kind], max(n, CHUNK) + 4096
            powers = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64))]
            _POWERS[kind] = (powers[0], powers[1])
        up, self.down = _POWERS[kind]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[kind][np.frombuffer(body, np.uint8)] * up[:n], out=self.sums[1:])

    def at(self, places: np.ndarray | None, depth: int) -> np.ndarray:
        """Of suffixes at some places, or of all that have ``depth`` bytes; not mixed yet."""
        if places is None:
            n = max(0, len(self.sums) - depth)
            return (self.sums[depth : depth + n] - self.sums[:n]) * self.down[:n]
        return (self.sums[places + depth] - self.sums[places]) * self.down[places]


def _order_checked(h: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The stable order by hash and then check; hashes that agree hardly ever differ in the check."""
    order = stable_order(h)
    same = h[order][1:] == h[order][:-1]
    return np.lexsort((checks, h)) if (checks[order][1:][same] != checks[order][:-1][same]).any() else order


def squeezed(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, byte by byte, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes())


def loosened(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(raw.reshape(8, -1).T.copy().view("<u8")[:, 0], dtype=np.uint64)


def pressed(body: bytes) -> bytes:
    """The bytes of a chunk as they are stored and shuffled."""
    return zstandard.ZstdCompressor().compress(body)


def _body(column: pa.Array, i: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(column[i].as_py())


class _Values:
    """The distinct prefix hashes of a chunk's suffixes, in order, and where their buckets begin.

    ``checks`` is a second hash for the last pass, else nothing; ``width`` is how many leading bits of a hash count.
    """

    def __init__(self, hashes: np.ndarray, checks: np.ndarray | None, width: int, buckets: int):
        h = hashes >> np.uint64(64 - width) if width < 64 else hashes
        order = stable_order(h) if checks is None else _order_checked(h, checks)
        h, c = h[order], None if checks is None else checks[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        if c is not None and len(h):
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        self.values, self.checks = h[first], None if c is None else c[first]
        self.counts = np.diff(np.r_[first, len(h)])
        self.number = np.empty(len(h), np.int64)  # of each suffix: the place of its hash among the values
        self.number[order] = np.cumsum(new) - 1
        self.first = order[first]  # the sort is stable, so this is the first suffix with each value
        step = -(-(1 << width) // buckets)
        bounds = np.array([min(b * step, 2**64 - 1) for b in range(1, buckets)], np.uint64)
        self.cuts = np.r_[0, np.searchsorted(self.values, bounds), len(self.values)]

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, values, checks) of the buckets that hold any."""
        for b in np.flatnonzero(np.diff(self.cuts)).tolist():
            some = slice(self.cuts[b], self.cuts[b + 1])
            yield b, squeezed(self.values[some]), b"" if self.checks is None else self.checks[some].astype("<u2").tobytes()

    def flags(self, replies: list[dict] | None) -> np.ndarray:
        """The owners' bit for each value; what they do not mention is 0."""
        out = np.zeros(len(self.values), bool)
        for r in replies or ():
            a, b = self.cuts[r["bucket"]], self.cuts[r["bucket"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
        return out


def _recurring(chunks: list[int], values: list[np.ndarray], checks: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, bit of each of its values): whether another chunk has it; with checks, whether a lower chunk has it."""
    rank = np.argsort(chunks, kind="stable").tolist()  # from here on the lowest chunk comes first
    chunks, values, checks = [chunks[i] for i in rank], [values[i] for i in rank], checks and [checks[i] for i in rank]
    every = np.concatenate(values)
    spread = every - every.min()  # all lie in one range
    if checks is None:
        order = stable_order(spread)
        same = every[order][1:] == every[order][:-1]
        hit = np.r_[False, same] | np.r_[same, False]
    else:
        c = np.concatenate(checks)
        order = _order_checked(spread, c)
        hit = np.r_[False, (every[order][1:] == every[order][:-1]) & (c[order][1:] == c[order][:-1])]
    bits = np.empty(len(every), bool)
    bits[order] = hit
    stops = np.cumsum([len(v) for v in values])
    for i, chunk in enumerate(chunks):
        yield chunk, bits[stops[i] - len(values[i]) : stops[i]]


def _answers(values: DataFrame, first: bool) -> DataFrame:
    """(chunk, replies): for each chunk the bits of its values, by bucket; chunks without a set bit are left out."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def settled() -> pa.RecordBatch:
            chunks, blobs, checks = zip(*held, strict=True)
            found = [loosened(b) for b in blobs]
            out = [(c, last, np.packbits(bits).tobytes()) for c, bits in _recurring(list(chunks), found, [np.frombuffer(c, "<u2") for c in checks] if first else None) if bits.any()]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "bits"])

        for batch in batches:
            for bucket, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and bucket != last:
                    yield settled()
                    held = []
                last = bucket
                held.append(row)
        if held:
            yield settled()

    dealt = values.select("bucket", "chunk", "found", "checks").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(own, "chunk long, bucket int, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))


def _packed(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """(chunk, n, k, text_hash, row, base, size, own, body): texts in the order of (k, text_hash, row), in chunks.

    The arrays have an entry for each part of a text: where it begins in its text, its bytes and those of them that are
    its own (the rest overlaps the next part). Chunk numbers grow in the order of texts.
    """
    rows = hashed_texts(docs).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "k", "text_hash", "row").sortWithinPartitions("k", "text_hash", "row")
    schema = "chunk long, n long, k array<long>, text_hash array<long>, row array<long>, base array<long>, size array<long>, own array<long>, body binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            lists = [pa.array([c], pa.list_(pa.int64())) for c in columns[:6]]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), *lists, pa.array([pressed(b"".join(columns[6]))], pa.binary())], names=["chunk", "n", "k", "text_hash", "row", "base", "size", "own", "body"])

        for batch in batches:
            for k, t, body, row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = 0
                while True:
                    stop = min(len(body), at + CHUNK)
                    while at < stop < len(body) and body[stop] & 0xC0 == 0x80:  # parts begin with characters
                        stop -= 1
                    part = body[at : stop + window - 1] if stop < len(body) else body[at:]
                    if held and (n + len(part) > CHUNK + window or len(held) >= 20_000):
                        yield chunk()
                        number, held, n = number + 1, [], 0
                    held.append((k, t, row, at, len(part), stop - at, part))
                    n += len(part)
                    at = stop
                    if at >= len(body):
                        break
        if held:
            yield chunk()

    return saved(dealt.select("k", "text_hash", "body", "row").mapInArrow(pack, schema), "suffix-chunks")


def _starts(sizes: np.ndarray, depth: int) -> np.ndarray:
    """Whether ``depth`` bytes from each place on lie within one of the parts that stand side by side."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    for a, b in zip(np.maximum(ends - depth + 1, ends - sizes).tolist(), ends.tolist(), strict=True):
        out[a:b] = False
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of true, and the places behind them."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edges[::2], edges[1::2]


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def _spans(docs: DataFrame, chunks: DataFrame, window: int) -> tuple[DataFrame, list[str]]:
    """(chunk, starts, stops): the bytes of each chunk, as runs, that repeated windows cover, after the three passes."""
    buckets_of = lambda n: max(partitions(docs.sparkSession), 1 + n // OWNED)
    total = int(chunks.agg(F.sum("n")).first()[0] or 0)
    one, two = max(1, window // 3), max(1, 2 * window // 3)
    values = "chunk long, bucket int, found binary, checks binary"

    def emitted(chunk: int, found: _Values) -> Iterator[pa.RecordBatch]:
        rows = list(found.rows())
        for at in range(0, len(rows), 64):
            columns = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(columns[0])), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["chunk", "bucket", "found", "checks"])

    def chosen(body: bytes, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes to the depth) of the suffixes of the first passes, of those that have as many bytes."""
        found = Prefixes(body)
        h = found.at(None, one) * np.uint64(_BASES[1])
        at = np.flatnonzero((h >> np.uint64(64 - SAMPLE) == 0) & _starts(sizes, depth)[: len(h)])
        return at, mixed(found.at(at, depth) + np.uint64(depth))

    def survivors(body: bytes, sizes: np.ndarray, at: np.ndarray, recurs: np.ndarray, depth: int) -> np.ndarray:
        """Whether a window begins at each place in which all chosen suffixes recur."""
        alone = np.zeros(len(body) + 1, np.int32)
        alone[at[~recurs] + 1] = 1
        alone = np.cumsum(alone)  # chosen suffixes before each place that do not recur
        left = _starts(sizes, window)
        some = np.flatnonzero(left)
        left[some] = alone[some + window - depth + 1] == alone[some]
        return left

    def whole_texts(body: bytes, sizes: np.ndarray) -> tuple[np.ndarray, _Values]:
        """Parts of a window at least, and their hashes."""
        ends, some = np.cumsum(sizes), np.flatnonzero(sizes >= window)
        digests = [xxhash.xxh3_128_intdigest(body[a:b]) for a, b in zip((ends - sizes)[some].tolist(), ends[some].tolist(), strict=True)]
        h, c = (np.array([d >> s & m for d in digests], t) for s, m, t in ((64, 2**64 - 1, np.uint64), (0, 2**16 - 1, np.uint16)))
        return some, _Values(h, c, 64, n_parts)

    def stretches(body: bytes, at: np.ndarray, left: np.ndarray, late: np.ndarray, chunk: int) -> pa.RecordBatch:
        """What is left: runs of windows that begin where ``left`` is true, with their places ``at`` in the chunk."""
        a, b = _runs(left)
        b = b + window - 1
        parts = [body[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (at[a], b - a, late)]
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(left.sum())]), *lists, pa.array([pressed(b"".join(parts))], pa.binary())], names=["chunk", "n", "at", "size", "late", "body"])

    # first pass: chosen suffixes by the first digit, and whole texts
    n_parts = partitions(docs.sparkSession)
    n_one = buckets_of(total >> SAMPLE)
    bits_one = min(64, (max(1, total >> SAMPLE)).bit_length() + 10)

    def send_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                _, h = chosen(_body(batch.column(2), i), _numbers(batch.column(1), i), one)
                yield from emitted(chunk, _Values(h, None, bits_one, n_one))

    def send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                yield from emitted(chunk, whole_texts(_body(batch.column(2), i), _numbers(batch.column(1), i))[1])

    def keep_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                body, sizes = _body(batch.column(2), i), _numbers(batch.column(1), i)
                at, h = chosen(body, sizes, one)
                found = _Values(h, None, bits_one, n_one)
                recurs = (found.counts > 1) | found.flags(batch.column(3)[i].as_py())
                left = survivors(body, sizes, at, recurs[found.number], one)
                some, texts = whole_texts(body, sizes)
                again = np.ones(len(some), bool)
                again[texts.first] = False
                again = some[again | texts.flags(batch.column(4)[i].as_py())[texts.number]]
                late = np.stack([(np.cumsum(sizes) - sizes)[again], np.cumsum(sizes)[again]], 1)
                for a, b in late.tolist():
                    left[a:b] = False
                if left.any() or len(late):
                    yield stretches(body, np.arange(len(body)), left, late.reshape(-1), chunk)

    columns = ["chunk", "size", "body"]
    answers = _answers(chunks.select(*columns).mapInArrow(send_chosen, values), False)
    texts = _answers(chunks.select(*columns).mapInArrow(send_texts, values), True).withColumnRenamed("replies", "texts")
    kept = chunks.select(*columns).join(answers.join(texts, "chunk", "full"), "chunk", "left").select(*columns, "replies", "texts")
    shape = "chunk long, n long, at array<long>, size array<long>, late array<long>, body binary"
    some, some_path = saved(kept.mapInArrow(keep_chosen, shape), "suffix-left")

    # second pass: the chosen suffixes that are left, by two digits
    n_some = int(some.agg(F.sum("n")).first()[0] or 0) >> SAMPLE
    n_two, bits_two = buckets_of(n_some), min(64, max(1, n_some).bit_length() + 10)

    def send_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                _, h = chosen(_body(batch.column(4), i), _numbers(batch.column(2), i), two)
                yield from emitted(chunk, _Values(h, None, bits_two, n_two))

    def keep_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                places, sizes, late = (_numbers(batch.column(c), i) for c in (1, 2, 3))
                body = _body(batch.column(4), i)
                at, h = chosen(body, sizes, two)
                found = _Values(h, None, bits_two, n_two)
                recurs = (found.counts > 1) | found.flags(batch.column(5)[i].as_py())
                left = survivors(body, sizes, at, recurs[found.number], two)
                if left.any() or len(late):
                    yield stretches(body, np.repeat(places - np.cumsum(sizes) + sizes, sizes) + np.arange(len(body)), left, late, chunk)

    columns = ["chunk", "at", "size", "late", "body"]
    answers = _answers(some.select(*columns).mapInArrow(send_left, values), False)
    kept = some.select(*columns).join(answers, "chunk", "left").select(*columns, "replies").mapInArrow(keep_left, shape)
    last, last_path = saved(kept, "suffix-last")
    remove(docs.sparkSession, some_path)

    # last pass: all suffixes that are left, by the whole window
    n_last = buckets_of(int(last.agg(F.sum("n")).first()[0] or 0))

    def whole(body: bytes, sizes: np.ndarray) -> tuple[np.ndarray, _Values]:
        at = np.flatnonzero(_starts(sizes, window))
        check = mixed(Prefixes(body, 1).at(at, window)) >> np.uint64(48)
        return at, _Values(mixed(Prefixes(body).at(at, window) + np.uint64(window)), check.astype(np.uint16), 64, n_last)

    def send_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                yield from emitted(chunk, whole(_body(batch.column(4), i), _numbers(batch.column(2), i))[1])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                places, sizes, texts = (_numbers(batch.column(c), i) for c in (1, 2, 3))
                at, found = whole(_body(batch.column(4), i), sizes)
                late = np.ones(len(at), bool)
                late[found.first] = False  # all but the first with a window are late, and that if a lower chunk has it
                late |= found.flags(batch.column(5)[i].as_py())[found.number]
                where = (np.repeat(places - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())))[at[late]]
                starts, stops = np.r_[where, texts[::2]], np.r_[where + window, texts[1::2]]
                if len(starts):
                    order = np.argsort(starts, kind="stable")
                    starts, reach = starts[order], np.maximum.accumulate(stops[order])
                    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([x], pa.list_(pa.int64())) for x in (starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]])]], names=["chunk", "starts", "stops"])

    answers = _answers(last.select(*columns).mapInArrow(send_whole, values), True)
    found = last.select(*columns).join(answers, "chunk", "left").select(*columns, "replies").mapInArrow(cover, "chunk long, starts array<long>, stops array<long>")
    spans, spans_path = saved(found, "suffix-spans")
    remove(docs.sparkSession, last_path)
    return spans, [spans_path]


def _kept_text(body: bytes, gone: np.ndarray) -> bytes:
    """What is left when whole characters are removed: a character of which a byte stays, stays."""
    x = np.frombuffer(body, np.uint8)
    first = np.flatnonzero((x & 0xC0) != 0x80)
    if not len(first):
        return body
    all_gone = np.minimum.reduceat(gone.astype(np.uint8), first).astype(bool)
    return x[~np.repeat(all_gone, np.diff(np.r_[first, len(x)]))].tobytes()


class _Text:
    """A text that comes part after part: what repeats is left out, the rest goes into the hash."""

    def __init__(self, k: int, t: int, text: bool):
        self.k, self.t, self.digest, self.texts = k, t, hashlib.sha256(), [] if text else None
        self.n = self.gone = self.spans = self.until = 0
        self.open = False

    def add(self, body: bytes, starts: np.ndarray, stops: np.ndarray) -> None:
        """``body``: the part's own bytes; spans are counted from its first and may go beyond it."""
        gone = np.zeros(len(body) + 1, np.int32)
        np.add.at(gone, np.minimum(np.r_[starts, 0], len(body)), 1)
        np.add.at(gone, np.minimum(np.r_[stops, max(0, self.until - self.n)], len(body)), -1)
        gone = np.cumsum(gone[:-1]) > 0
        self.until = max([self.until, *(self.n + stops[-1:]).tolist()])
        if gone.any():
            x = np.frombuffer(body, np.uint8)
            self.spans += int(np.count_nonzero(np.diff(np.r_[self.open, gone].astype(np.int8)) == 1))
            self.gone += int(gone.sum())
            self.digest.update(x[~gone].tobytes())
        else:
            self.digest.update(body)
        if self.texts is not None:
            self.texts.append(_kept_text(body, gone) if gone.any() else body)
        self.n += len(body)
        if len(body):
            self.open = bool(gone[-1])

    def row(self) -> tuple:
        return (self.k, self.t, self.n, self.gone, self.spans, self.digest.hexdigest(), *([] if self.texts is None else [b"".join(self.texts).decode() if self.gone else None]))


def _cut(docs: DataFrame, window: int, text: bool) -> DataFrame:
    """k, text_hash, n_bytes, n_removed, n_spans, kept_sha256 and, with ``text``, kept_text (null where all is kept)."""
    if window < 8:
        raise ValueError("window must be 8 at least")
    bounded_batches(docs.sparkSession)
    chunks, chunks_path = _packed(docs, window)
    spans, paths = _spans(docs, chunks, window)
    kinds = [("k", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * text]
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    schema = lambda fields: ", ".join(f"{n} {names[t]}" for n, t in fields)
    arrays = lambda fields, rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
    part_kinds = [("row", pa.int64()), ("base", pa.int64()), ("body", pa.binary()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))]

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """k, text hash, row, base, whether it is the whole text, own bytes, starts and stops of each part."""
        for batch in batches:
            for i in range(batch.num_rows):
                k, t, row, base, size, own = (_numbers(batch.column(c), i) for c in range(1, 7))
                body = _body(batch.column(7), i)
                starts, stops = (np.zeros(0, np.int64) if not batch.column(c)[i].is_valid else _numbers(batch.column(c), i) for c in (8, 9))
                at = np.cumsum(size) - size
                # windows lie within parts, so no run of removed bytes is cut by where a part ends in the chunk but touching ones
                low, high = np.searchsorted(stops, at, side="right"), np.searchsorted(starts, at + size)
                for j in range(len(k)):
                    a, b = starts[low[j] : high[j]] - at[j], stops[low[j] : high[j]] - at[j]
                    yield int(k[j]), int(t[j]), int(row[j]), int(base[j]), base[j] == 0 and size[j] == own[j], body[at[j] : at[j] + own[j]], np.maximum(a, 0), np.minimum(b, size[j])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for k, t, _, _, alone, body, starts, stops in parts_of(batches):
            if alone:
                made = _Text(k, t, text)
                made.add(body, starts, stops)
                out.append(made.row())
                held += len(body)
            if held > CHUNK or len(out) >= 10_000:
                yield arrays(kinds, out)
                out, held = [], 0
        if out:
            yield arrays(kinds, out)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t, row, base, alone, body, starts, stops in parts_of(batches):
            if not alone:
                yield arrays([*kinds[:2], *part_kinds], [(k, t, row, base, pressed(body), starts, stops)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                k, t, row = (batch.column(c)[i].as_py() for c in range(3))
                if made and row != last:
                    yield arrays(kinds, [made.row()])
                    made = None
                made, last = made or _Text(k, t, text), row
                made.add(_body(batch.column(4), i), _numbers(batch.column(5), i), _numbers(batch.column(6), i))
        if made:
            yield arrays(kinds, [made.row()])

    # texts of several parts are rare: a chunk that holds one has a part with a base, or with bytes of the next
    long = F.exists("base", lambda x: x > 0) | F.exists(F.arrays_zip("size", "own"), lambda x: x["size"] != x["own"])
    columns = ["chunk", "k", "text_hash", "row", "base", "size", "own", "body", "starts", "stops"]
    placed = chunks.join(spans, "chunk", "left").select(*columns)
    parts = chunks.where(long).join(spans, "chunk", "left").select(*columns).mapInArrow(several, schema([*kinds[:2], *part_kinds]))
    parts = parts.repartition("row").sortWithinPartitions("row", "base")
    return placed.mapInArrow(whole, schema(kinds)).unionByName(parts.mapInArrow(joined, schema(kinds)))


def dedup_windows(docs: DataFrame, window: int = 100, text: bool = False) -> DataFrame:
    """Removes every byte that a ``window``-byte string covers which also starts earlier: in a document of a smaller
    id, or before in the same one. Strings are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 for each document; with ``text``
    also kept_text, of which only whole characters are removed (null where nothing is). Null and empty texts, and texts
    shorter than the window, lose nothing; a null id counts as the smallest. Rows that repeat an id are documents of
    their own, earlier or later by a hash of the text; of those that agree in the text too, one comes first. An empty
    table gives no rows. Texts may be of any length.
    """
    out = _cut(docs, window, text)
    return out.select(unkey("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * text)


def remove_repeats(docs: DataFrame, window: int = 100) -> DataFrame:
    """The documents, all columns, with texts less their repeated windows; n_chars follows where there is such a column.

    Null texts stay null. Only texts that change join the documents, by id and a hash of the input; rows that agree in
    both are numbered, and as many of them change as there are changed texts.
    """
    changed, _ = saved(_cut(docs, window, text=True).where("n_removed > 0").select("k", "text_hash", "kept_text"), "suffix-changed")
    turn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[1]))
    names = ("k", "text_hash", "turn", "kept_text")
    mine = dict(zip(names, fresh(docs, *names), strict=True))
    changed = changed.withColumn("turn", turn("k", "text_hash")).withColumnsRenamed(mine)
    rest = docs.withColumns({mine["k"]: key(), mine["text_hash"]: text_hash()})
    out = rest.withColumn(mine["turn"], turn(mine["k"], mine["text_hash"])).join(changed, [mine[n] for n in ("k", "text_hash", "turn")], "left")
    kept = F.col(mine["kept_text"])
    new = {"text": F.coalesce(kept, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(kept), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
