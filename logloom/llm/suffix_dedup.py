"""Suffix-array deduplication: bytes covered by a repeated `length`-byte string are removed.

Only a sparse set of suffixes is sorted. Every window of `length` bytes has an anchor: the place of
its smallest `gram`-byte hash. Equal windows have equal anchors, so two equal windows are two
anchored suffixes with the same `gram` bytes in front, at least `length` minus the anchor's offset
equal bytes to the right, and at least that offset to the left. Anchors whose gram occurs once in
all documents are left out; the others are sorted by the text to their right (at most `length`
bytes) in a distributed merge sort:

* every map task sorts the suffixes of a bounded amount of text into a run and cuts it by a hash of
  the first `gram` bytes, so suffixes that can match meet; the pieces are exchanged front-coded
  (length shared with the suffix before, and the rest);
* every reducer merges the pieces of a bucket with a loser tree that carries common prefix lengths:
  contestants with different lengths are ranked without looking at the text, those with equal
  lengths are compared behind the known prefix only.

The merged order gives right common lengths; the text to the left decides whether two suffixes share a whole
window. The longest reach to each side over all partners that share a window is exact: partners
are visited from the longest common side on and the visit ends with the first that qualifies.

Equal contexts (the whole text an anchor can need, left and right) are sent once per run with their
number, and the verdict goes back to all places with that context by a join, so copies in any
number do not meet in one task. Matches never cross documents.

A gram with more than `crowd` places (a line that millions of texts hold) could bring too many contexts
into one group. Its distinct contexts are counted; up to `crowd` of them form a group, one place for each. More are dealt on by
the offset of a window to its anchor: offsets are cut into four ranges, again and again, and all windows of a range have a
core in common. Contexts that agree on all the text that the windows of a range cover are repeated there, and one of
them stands for all; the ones that differ but have the same core are compared in a group, or cut further if there are more than
`crowd`. Partners so meet in at least one group, and the reach is the largest over the groups.

Defined results: a null text is an empty text; repeated rows count as separate documents, so both
lose their bytes; texts under `length` bytes stay whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import small_batches
from logloom.session import cut_lineage

LENGTH = 400
GRAM = 100
RUN_BYTES = 16_000_000  # context bytes sorted into one run
BLOCK = 1 << 19  # window starts hashed at once
BUCKETS_PER_PARTITION = 4
CROWD = 10_000  # places of a gram, or distinct contexts with a common text, that may form one group
RANGES = 4  # parts that a range of offsets is cut into, for crowded grams
GROUPS = 16  # groups per `crowd` crowded places
CONTEXTS = 50_000  # contexts that a task folds at once
WALK = 200  # contexts of a group up to which partners are visited one by one
BROADCAST_PLACES = 400_000  # places sent to the texts instead of the texts to the places, 60 bytes each
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up, down = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    for out, base in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
        out[0], size = 1, 1
        factor = np.array([base & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
        while size < n:
            take = min(size, n - size)
            out[size:size + take] = out[:take] * factor
            factor = factor * factor
            size += take
    return up, down


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best() over every window of `width` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places that carry the smallest gram hash of some window, and those hashes. Ties are all kept."""
    width = length - gram + 1
    places, hashes = [], []
    up, down = _powers(BLOCK + length + 1)
    for low in range(0, len(data) - length + 1, BLOCK):
        part = np.frombuffer(data, dtype=np.uint8, count=min(BLOCK + length - 1, len(data) - low), offset=low)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=sums[1:])
        code = (sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1]
        code ^= code >> np.uint64(32)
        code *= np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
        value = (code >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        least = _slide(value, width, np.minimum)
        pad = np.zeros(width - 1, dtype=np.uint32)
        most = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
        here = np.flatnonzero(most == value)
        places.append(here + low)
        hashes.append(code[here])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place.astype(np.int64), np.concatenate(hashes)[first].view(np.int64)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that the first `known` bytes are equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class Run:
    """A front-coded run, read suffix by suffix."""

    def __init__(self, blob: bytes):
        (self.size,) = struct.unpack_from("<I", blob)
        head = np.frombuffer(blob, dtype="<u2", count=4 * self.size, offset=4).reshape(4, self.size).tolist()
        self.common, self.rest, self.left, self.count = head
        self.ids = 4 + 8 * self.size
        self.at = self.ids + 16 * self.size
        self.left_at = self.at + sum(self.rest)
        self.blob, self.next, self.text = blob, 0, b""

    def advance(self) -> int:
        """Steps to the next suffix; its length shared with the one before, -1 at the end."""
        k = self.next
        if k == self.size:
            return -1
        stop = self.at + self.rest[k]
        self.text = self.text[:self.common[k]] + self.blob[self.at:stop]
        self.at = stop
        self.next = k + 1
        return self.common[k]

    def record(self) -> tuple[bytes, bytes, int, bytes]:
        """(right, left reversed, count, id) of the current suffix; called once per suffix, in order."""
        k = self.next - 1
        start = self.left_at
        self.left_at = start + self.left[k]
        return self.text, self.blob[start:self.left_at], self.count[k], self.blob[self.ids + 16 * k:self.ids + 16 * k + 16]


def encode_run(records: list[tuple[bytes, bytes, int, bytes]]) -> bytes:
    """Sorted records (right, left reversed, count, id) as one front-coded piece."""
    common, rests = [], []
    before = b""
    for right, *_ in records:
        n = shared(before, right)
        common.append(n)
        rests.append(right[n:])
        before = right
    head = np.array([common, [len(r) for r in rests], [len(r[1]) for r in records], [min(r[2], 2) for r in records]],
                    dtype="<u2")
    return b"".join([struct.pack("<I", len(records)), head.tobytes(), *[r[3] for r in records], *rests,
                     *[r[1] for r in records]])


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, tuple[bytes, bytes, int, bytes]]]:
    """All records in order with the length each shares with the one before, by a loser tree.

    A node keeps the run that lost there and the length it shares with the winner of that match.
    Lengths are relative to the last record put out for all runs on its path, so the longer one wins
    unseen; only a draw reads text, and only behind the shared part.
    """
    size = 1
    while size < len(runs):
        size *= 2
    loser, known = [-1] * size, [-1] * size

    def play(run: int, length: int, other: int, other_length: int) -> tuple[int, int, int, int]:
        """(winner, its length, loser, length it shares with the winner)."""
        if other_length > length:
            return other, other_length, run, length
        if other_length < length or length < 0:
            return run, length, other, other_length
        a, b = runs[run].text, runs[other].text
        n = shared(a, b, length)
        # equal suffixes: the lower run first
        if (a[n:n + 1], run) <= (b[n:n + 1], other):
            return run, length, other, n
        return other, length, run, n

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            run = node - size
            return (run, 0 if runs[run].advance() >= 0 else -1) if run < len(runs) else (-1, -1)
        run, length = build(2 * node)
        other, other_length = build(2 * node + 1)
        run, length, loser[node], known[node] = play(run, length, other, other_length)
        return run, length

    winner, length = build(1) if size > 1 else (0, 0 if runs[0].advance() >= 0 else -1)
    while length >= 0:
        yield length, runs[winner].record()
        length = runs[winner].advance()
        node = (winner + size) // 2
        while node:
            winner, length, loser[node], known[node] = play(winner, length, loser[node], known[node])
            node //= 2


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    """Texts as rows of bytes; 255, which UTF-8 never holds, fills up."""
    out = np.full((len(texts), width), 255, dtype=np.uint8)
    for i, text in enumerate(texts):
        out[i, :len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common prefix length of rows, at most `limit`."""
    differ = a != b
    return np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), limit), limit)


def _best(i: int, rank: np.ndarray, order: np.ndarray, near: np.ndarray, other: np.ndarray, sizes: np.ndarray,
          floor: int, length: int) -> int:
    """The largest common length of row i on the sorted side over partners that share a window with it, or 0.

    `near[k]` is the common length of the rows at k - 1 and k of the order. Partners are visited outwards in both
    directions; a side is left when its common length is below `floor` or below the best found.
    """
    best = 0
    for way in (-1, 1):
        at, reach, step = int(rank[i]), 1 << 30, 16
        while True:
            low, high = (max(at - step, 0), at) if way < 0 else (at + 1, min(at + 1 + step, len(order)))
            if low >= high:
                break
            lengths = near[low + 1:high + 1][::-1] if way < 0 else near[low:high]
            lengths = np.minimum(np.minimum.accumulate(lengths), reach)
            rows = order[low:high][::-1] if way < 0 else order[low:high]
            alive = lengths >= max(floor, best + 1)
            if not alive[0]:
                break
            rows, lengths = rows[alive], lengths[alive]
            sides = _common(other[rows], other[i][None, :], np.minimum(sizes[rows], sizes[i]))
            good = np.flatnonzero(sides + lengths >= length)
            if len(good):
                best = max(best, int(lengths[good[0]]))
                break
            if len(rows) < high - low:
                break
            reach, at, step = int(lengths[-1]), (low if way < 0 else high - 1), min(4 * step, 1024)
    return best


def _reaches(right_near: np.ndarray, left_near: np.ndarray, left_rank: np.ndarray, most_left: np.ndarray, most_right: np.ndarray,
             length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest left and right reach of all rows (0 for none): per offset, rows equal on both sides share that window."""
    n = len(left_rank)
    back, ahead = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for offset in range(length - gram + 1):
        rows = np.flatnonzero((most_left >= offset) & (most_right >= length - offset))
        if len(rows) < 2:
            continue
        right = np.cumsum(right_near[:n] < length - offset)[rows]
        left = np.cumsum(left_near[:n] < offset)[left_rank[rows]]
        key = left * (n + 1) + right
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = rows[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        back[twice] = offset
        ahead[twice] = np.maximum(ahead[twice], length - offset)
    return back, ahead


def solve_group(records: list[tuple[bytes, bytes, int, bytes]], near: list[int], length: int = LENGTH,
                gram: int = GRAM) -> Iterator[tuple[bytes, int, int]]:
    """(id, left, right) of every context with a repeated window: the reach of its covered bytes.

    `records` are in order of their right text, `near[k]` is what records k - 1 and k share.
    """
    index: dict[bytes, int] = {}
    kept: list[tuple[bytes, bytes, int, bytes]] = []
    between: list[int] = []
    low = 1 << 30
    for record, n in zip(records, near, strict=True):
        low = min(low, n)
        if record[3] in index:
            k = index[record[3]]
            kept[k] = (*kept[k][:2], kept[k][2] + record[2], record[3])
            continue
        index[record[3]] = len(kept)
        kept.append(record)
        between.append(low)
        low = 1 << 30
    whole = [r[2] > 1 for r in kept]
    for record, full in zip(kept, whole, strict=True):
        if full and len(record[0]) + len(record[1]) >= length:
            yield record[3], len(record[1]), len(record[0])
    n = len(kept)
    if n < 2 or all(whole):
        return
    right_sizes, left_sizes = np.array([len(r[0]) for r in kept]), np.array([len(r[1]) for r in kept])
    left = _matrix([r[1] for r in kept], length - gram)
    right_near = np.array([0, *between[1:], 0])
    right_order = np.arange(n)
    texts = np.empty(n, dtype=object)
    texts[:] = [r[1] for r in kept]
    left_order = np.argsort(texts, kind="stable")
    left_rank = np.empty(n, dtype=np.int64)
    left_rank[left_order] = np.arange(n)
    a, b = left_order[:-1], left_order[1:]
    left_near = np.concatenate(([0], _common(left[a], left[b], np.minimum(left_sizes[a], left_sizes[b])), [0]))
    most_right = np.maximum(right_near[:-1], right_near[1:])
    most_left = np.empty(n, dtype=np.int64)
    most_left[left_order] = np.maximum(left_near[:-1], left_near[1:])
    if n > WALK:
        backs, aheads = _reaches(right_near, left_near, left_rank, most_left, most_right, length, gram)
        for i in np.flatnonzero(aheads):
            if not whole[i]:
                yield kept[i][3], int(backs[i]), int(aheads[i])
        return
    right = _matrix([r[0] for r in kept], length)
    for i in np.flatnonzero(most_left + most_right >= length):
        if whole[i]:
            continue
        reach = _best(i, right_order, right_order, right_near, left, left_sizes, length - int(most_left[i]), length)
        if reach:
            back = _best(i, left_rank, left_order, left_near, right, right_sizes, length - int(most_right[i]), length)
            yield kept[i][3], back, reach


def _context(data: bytes, place: int, length: int, gram: int) -> tuple[bytes, bytes, bytes]:
    """(right, left reversed, id) around an anchor; the id is a hash of both texts."""
    right = data[place:place + length]
    left = data[max(0, place - (length - gram)):place][::-1]
    return right, left, hashlib.blake2b(struct.pack("<H", len(left)) + left + right, digest_size=16).digest()


def _longs(ids: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(ids), dtype="<i8").reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs, cut by bucket: bucket, the piece."""
    found: dict[tuple[int, bytes], list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        by_bucket: dict[int, list] = {}
        for (bucket, key), (right, left, count) in found.items():
            by_bucket.setdefault(bucket, []).append((right, left, count, key))
        for bucket, records in sorted(by_bucket.items()):
            records.sort(key=lambda r: (r[0], r[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([encode_run(records)], pa.binary())], ["bucket", "piece"])
        found.clear()
        size = 0

    for batch in batches:
        for data, places, dealt in zip(*[batch.column(c) for c in ("data", "places", "dealt")], strict=True):
            data = data.as_py()
            spots = [(place, zlib.crc32(data[place:place + gram]) % buckets) for place in set(places.as_py())]
            spots += {(spot["place"], buckets + spot["deal"]) for spot in dealt.as_py() or ()}
            for place, bucket in sorted(spots):
                right, left, key = _context(data, place, length, gram)
                entry = found.get((bucket, key))
                if entry is None:
                    found[bucket, key] = [right, left, 1]
                    size += len(right) + len(left) + 200
                else:
                    entry[2] += 1
                if size > RUN_BYTES:
                    yield from flush()
    yield from flush()


def _origins(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Which context stands where."""
    for batch in batches:
        ids, k1, k2, place = [], [], [], []
        for a, b, data, places, crowded in zip(
                *[batch.column(c) for c in ("k1", "k2", "data", "places", "crowded")], strict=True):
            data = data.as_py()
            for at in sorted({*places.as_py(), *crowded.as_py()}):
                ids.append(_context(data, at, length, gram)[2])
                k1.append(a.as_py())
                k2.append(b.as_py())
                place.append(at)
        first, second = _longs(ids)
        yield pa.RecordBatch.from_arrays(
            [first, second, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(place, pa.int32())],
            ["c1", "c2", "k1", "k2", "place"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The contexts of crowded grams, once for many places, with the first of the places, their number and a hash of the gram."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    found: dict[bytes, list] = {}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*[(*one, *rest) for one, *rest in found.values()], strict=True)) if found else [()] * len(kinds)
        batch = pa.RecordBatch.from_arrays(
            [*_longs(list(found)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            ["c1", "c2", "k1", "k2", "place", "back", "ahead", "n", "gram"])
        found.clear()
        return batch

    for batch in batches:
        for k1, k2, data, crowded in zip(*[batch.column(c) for c in ("k1", "k2", "data", "crowded")], strict=True):
            k1, k2, data = k1.as_py(), k2.as_py(), data.as_py()
            for place in sorted(set(crowded.as_py())):
                right, left, key = _context(data, place, length, gram)
                entry = found.get(key)
                if entry is None:
                    code = hashlib.blake2b(right[:gram], digest_size=16).digest()
                    found[key] = [(k1, k2, place), len(left), len(right), 1, code]
                else:
                    entry[0] = min(entry[0], (k1, k2, place))
                    entry[3] += 1
        if len(found) > CONTEXTS:
            yield flush()
    yield flush()


def _texts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts at given places: their text, and how much of it stands before the anchor."""
    for batch in batches:
        ids, rows = [], []
        for k1, k2, data, spots in zip(*[batch.column(c) for c in ("k1", "k2", "data", "spots")], strict=True):
            k1, k2, data = k1.as_py(), k2.as_py(), data.as_py()
            for place in sorted(set(spots.as_py())):
                right, left, key = _context(data, place, length, gram)
                ids.append(key)
                rows.append((k1, k2, place, len(left), left[::-1] + right))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*_longs(ids), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            ["c1", "c2", "k1", "k2", "place", "back", "text"])


def _merged(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Verdicts of the contexts of each bucket; rows come ordered by bucket."""

    def solve(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int]] = []
        group: list = []
        near: list[int] = []
        for common, record in merge_runs([Run(r) for r in runs]):
            if common < gram and group:
                out.extend(solve_group(group, near, length, gram))
                group, near = [], []
            group.append(record)
            near.append(common)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if group:
            out.extend(solve_group(group, near, length, gram))
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        first, second = _longs([o[0] for o in out])
        return pa.RecordBatch.from_arrays(
            [first, second, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())],
            ["c1", "c2", "back", "ahead"])

    bucket, runs = None, []
    for batch in batches:
        for number, piece in zip(batch.column("bucket").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if number != bucket:
                if runs:
                    yield from solve(runs)
                bucket, runs = number, []
            runs.append(piece)
    if runs:
        yield from solve(runs)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _with_places(rows: DataFrame, listed: DataFrame, n_places: int) -> DataFrame:
    """Texts with the places listed for them: few places go to the texts, many meet them in an exchange."""
    return rows.join(F.broadcast(listed) if n_places <= BROADCAST_PLACES else listed, ["k1", "k2"])


def _deal_crowded(rows: DataFrame, places: DataFrame, total: int, length: int, gram: int,
                  crowd: int) -> tuple[DataFrame, DataFrame]:
    """How the contexts of crowded grams are dealt on (k1, k2, dealt), and the verdicts that need no comparison.

    `total` is the number of crowded places; it sets the number of groups.
    """
    here = _with_places(rows, places.filter(F.size("crowded") > 0).select("k1", "k2", "crowded"), total)
    contexts = cut_lineage(
        here.mapInArrow(
            lambda b: _contexts(b, length, gram),
            "c1 long, c2 long, k1 long, k2 long, place int, back int, ahead int, n long, gram binary",
        ).groupBy("c1", "c2").agg(
            F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"), F.first("gram").alias("gram"),
            F.first("back").alias("back"), F.first("ahead").alias("ahead")))
    # a context that occurs again is repeated as a whole
    known = contexts.filter((F.col("n") > 1) & (F.col("back") + F.col("ahead") >= length)).select("c1", "c2", "back", "ahead")

    groups = max(1, -(-total * GROUPS // crowd))
    deal = F.pmod(F.xxhash64("core"), F.lit(groups)).cast("int").alias("deal")
    often = cut_lineage(contexts.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1"))
    near = contexts.join(often, "gram").withColumnRenamed("gram", "core")
    dealt = near.filter(F.col("size") <= crowd).select("one.*", deal)
    n_open = often.filter(F.col("size") > crowd).agg(F.sum("size")).first()[0]
    if n_open is not None:
        spots = near.filter(F.col("size") > crowd).select("one.*").groupBy("k1", "k2").agg(F.collect_list("place").alias("spots"))
        nodes = _with_places(rows, spots, n_open).mapInArrow(
            lambda b: _texts(b, length, gram), "c1 long, c2 long, k1 long, k2 long, place int, back int, text binary"
        ).dropDuplicates(["c1", "c2"])  # rows of the table may be equal
        nodes = cut_lineage(nodes.select("*", F.lit(0).alias("low"), F.lit(length - gram + 1).alias("high")))
        step = length - gram + 1
        while step > 1 and not nodes.isEmpty():
            step = -(-step // RANGES)
            nodes, compared, repeated = _cut_ranges(nodes, step, length, crowd)
            dealt, known = dealt.unionByName(compared.select("k1", "k2", "place", deal)), known.unionByName(repeated)
    return dealt.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "deal")).alias("dealt")), known


def _cut_ranges(nodes: DataFrame, step: int, length: int, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One cut of ranges of offsets: contexts to cut further, those to compare (by core), and verdicts.

    A node is a context and a range, low to high, of offsets; a window of offset o starts o bytes before the anchor. Its text is cut to
    what the windows of the range cover.
    """
    ids = ["c1", "c2", "k1", "k2", "place"]
    parts = nodes.withColumn("part", F.explode(F.expr(f"sequence(low, high - 1, {step})"))).select(
        *ids, "back", "text", F.col("part").alias("low"), F.least(F.col("part") + step, F.col("high")).alias("high"))
    # the document may end before the core does
    parts = parts.filter("back >= low").filter(F.length("text") - F.col("back") > length - F.col("high"))
    left = F.least(F.col("back"), F.col("high") - 1)
    right = F.least(F.length("text") - F.col("back"), length - F.col("low"))
    core = F.substring(F.col("text"), F.col("back") - F.col("low") + 1, F.col("low") + length - F.col("high") + 1)
    parts = parts.select(
        *ids, "low", "high", F.xxhash64("low", "high", core).alias("core"), left.alias("back"), right.alias("ahead"),
        F.substring(F.col("text"), F.col("back") - left + 1, left + right).alias("text"),
    ).withColumn("whole", F.unhex(F.md5("text")))
    same = ["core", "low", "high", "back", "ahead", "whole"]
    sides = cut_lineage(parts.groupBy(*same).agg(
        F.count("*").alias("n"), F.min(F.struct(*ids)).alias("one"), F.first("text").alias("text")))
    often = sides.filter((F.col("n") > 1) & (F.col("back") + F.col("ahead") >= length)).select(*same)
    repeated = parts.select("c1", "c2", *same).join(often, same).select("c1", "c2", "back", "ahead")
    met = cut_lineage(sides.groupBy("core").agg(F.count("*").alias("size")).filter("size > 1"))
    near = sides.join(met, "core").select("one.*", "core", "size", "low", "high", "back", "text")
    further = cut_lineage(near.filter(F.col("size") > crowd).drop("core", "size"))
    return further, near.filter(F.col("size") <= crowd), repeated


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM,
                   crowd: int = CROWD) -> DataFrame:
    """doc_id, data (the text's bytes) and spans (start, end of repeated text, unmerged; null for none)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(1), F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(2), F.col(id_col), text).alias("k2"),
        text.cast("binary").alias("data"),
    )

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, codes, k1, k2 = [], [], [], []
            for a, b, data in zip(*[batch.column(c) for c in ("k1", "k2", "data")], strict=True):
                place, code = anchors(data.as_py(), length, gram)
                places.append(place)
                codes.append(code)
                k1.append(np.full(len(place), a.as_py(), dtype=np.int64))
                k2.append(np.full(len(place), b.as_py(), dtype=np.int64))
            if places:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(codes)), pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2)),
                     pa.array(np.concatenate(places).astype(np.int32))], ["gram", "k1", "k2", "place"])

    long_rows = rows.filter(F.length("data") >= length).select("k1", "k2", "data")
    found = long_rows.mapInArrow(grams, "gram long, k1 long, k2 long, place int")
    # a gram that occurs once can be in no repeated window
    # stored, so the join below has plain exchanges on both sides and hot grams can be split
    often = cut_lineage(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    calm = F.col("n") <= crowd
    places = found.join(often, "gram").groupBy("k1", "k2").agg(
        F.collect_list(F.when(calm, F.col("place"))).alias("places"),
        F.collect_list(F.when(~calm, F.col("place"))).alias("crowded"))
    places = cut_lineage(places)  # used twice; numbers only
    total = often.filter(~calm).agg(F.sum("n")).first()[0]
    known = None
    if total is None:
        places = places.withColumn("dealt", F.lit(None).cast("array<struct<place:int,deal:int>>"))
    else:
        dealt, known = _deal_crowded(rows, places, total, length, gram, crowd)
        places = cut_lineage(places.join(dealt, ["k1", "k2"], "left"))
    # the same exchange of the texts serves both uses here and the last join
    placed = rows.join(places, ["k1", "k2"]).select("doc_id", "k1", "k2", "data", "places", "crowded", "dealt")

    pieces = placed.mapInArrow(
        lambda b: _pieces(b, length, gram, buckets), "bucket int, piece binary"
    ).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    verdicts = pieces.mapInArrow(lambda b: _merged(b, length, gram), "c1 long, c2 long, back int, ahead int")
    if known is not None:
        verdicts = verdicts.unionByName(known)
    origins = placed.mapInArrow(lambda b: _origins(b, length, gram), "c1 long, c2 long, k1 long, k2 long, place int")
    spans = origins.join(verdicts, ["c1", "c2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct(
        (F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"))).alias("spans"))
    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed runs (start, end) and the bytes that stay. `crowd` bounds a task, not results."""
    found = repeated_spans(docs, id_col, text_col, length, gram, crowd)
    kind = dict(found.dtypes)["doc_id"]

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = size = 0
            sizes, removed, kept = [], [], []
            for row in range(batch.num_rows):
                data = batch.column("data")[row].as_py()
                spans = merge_spans([(s["start"], s["end"]) for s in batch.column("spans")[row].as_py() or ()])
                parts, at = [], 0
                for start, end in spans:
                    parts.append(data[at:start])
                    at = end
                parts.append(data[at:])
                sizes.append(len(data))
                removed.append(spans)
                kept.append(b"".join(parts))
                size += len(data)
                if size > RUN_BYTES or row == batch.num_rows - 1:  # bounded output batches
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(low, len(sizes)), pa.array(sizes, pa.int64()),
                        pa.array([sum(e - s for s, e in spans) for spans in removed], pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in spans] for spans in removed], span),
                        pa.array(kept, pa.binary()),
                    ], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])
                    low, size = row + 1, 0
                    sizes, removed, kept = [], [], []

    return found.mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
