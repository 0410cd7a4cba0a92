"""Near duplicates by Order MinHash, verified by banded alignment.

A text is a row of five-word shingles; a shingle that occurs again carries the number of its
occurrence. One sketch takes the `take` shingles with the smallest hashes and keeps them in text
order, so two texts share a sketch only if they share these shingles in this order. Texts that
share any of `sketches` sketches are candidates: at similarity s a sketch agrees with chance
about s ** take, so 1 - (1 - 0.8 ** 3) ** 20 > 0.999999 of the pairs at the threshold are found.

Candidates are verified on their shingle rows: matched shingles of the best order-keeping alignment
over all shingles of both, at least `similarity`. The alignment runs in the band that a similar
pair cannot leave, as a bit vector.

Work per bucket (texts with an equal sketch) is not all pairs. First every text is compared with
one centre of its buckets, twice with different centres; linked texts form classes. Then texts of
different classes that still share a bucket are compared: all of them where few classes meet. Texts of
crowded buckets are joined on their rarest shingles, one of which every similar pair shares, with as many shingles
left behind it as a similar pair needs. So copies and near copies in any number cost some comparisons each, and a
passage that very many texts share costs no square.

Words are runs of letters, digits and non-ASCII characters in lower case. Texts with equal words are
copies and share one vertex. Defined results: a text without words (null, empty, symbols only) is
a class of its own; a text of fewer than five words is one shingle; repeated rows fall into one
class; a null id counts as largest when a class picks its smallest id; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import row_keys, small_batches
from logloom.session import cut_lineage

SHINGLE = 5
SKETCHES = 20
TAKE = 3
CROWD = 32  # classes of a bucket that are all compared with each other
SIMILARITY = 0.8
CELLS = 1 << 18  # hashes held at once while sketching a text
COUNTER_BITS = 20  # counters of shingle frequencies: 2 ** bits
PARITY_BITS = 512  # bits of the parities that tell how much two sets of shingles differ at least
DEALT = 64  # classes of a shingle that one task pairs with all others of it
_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    out = np.empty(n, dtype=np.uint64)
    out[0], size = 1, 1
    factor = np.array([_ODD], dtype=np.uint64)
    while size < n:
        take = min(size, n - size)
        out[size:size + take] = out[:take] * factor
        factor = factor * factor
        size += take
    return out


def word_hashes(text: str) -> np.ndarray:
    """One hash per word of a text, in order."""
    data = np.frombuffer(text.lower().encode("utf-8", "ignore"), dtype=np.uint8)
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    # a polynomial over each word's own bytes: every byte is weighted by its distance from the word's start
    inside = np.flatnonzero(letter)
    sizes = last - first
    starts = np.cumsum(sizes) - sizes
    distance = np.arange(len(inside)) - np.repeat(starts, sizes)
    longest = int(sizes.max())
    powers = _powers(1 << max(10, (longest + 1).bit_length()))
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[distance]
    return mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles; a shorter row of words is one shingle."""
    size = min(SHINGLE, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(_ODD) + words[j:len(words) - size + 1 + j]
    return mix(out + np.uint64(size))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value occurred before."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.arange(len(values))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = rank - np.maximum.accumulate(np.where(new, rank, 0))
    return out


def sketch(shingles: np.ndarray, sketches: int = SKETCHES, take: int = TAKE) -> np.ndarray:
    """One hash per sketch: its number and the smallest labelled shingles in text order."""
    labelled = mix(shingles + occurrences(shingles).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(_ODD))
    out = np.empty(sketches, dtype=np.uint64)
    step = max(1, CELLS // len(labelled))
    for low in range(0, sketches, step):
        values = mix(labelled[None, :] ^ seeds[low:low + step, None])
        if len(labelled) > take:
            picked = np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)
        else:
            picked = np.broadcast_to(np.arange(len(labelled)), values.shape)
        code = seeds[low:low + step].copy()
        for j in range(picked.shape[1]):
            code = mix(code * np.uint64(_ODD) + shingles[picked[:, j]])
        out[low:low + step] = code
    return out


def _needed(n: int, m: int, similarity: float) -> int:
    """The least number of matched shingles x with x / (n + m - x) >= similarity."""
    x = int(similarity * (n + m) / (1 + similarity))
    while x < similarity * (n + m - x) - 1e-9:
        x += 1
    return x


def banded_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of a and b with |i - j| <= band, by a bit vector that slides with the band.

    Bit k of the vector stands for place i - band + k of `a`; a zero bit is a step of the count.
    """
    places: dict[int, list[int]] = {}
    for place, value in enumerate(a.tolist()):
        places.setdefault(value, []).append(place)
    width = 2 * band + 1
    full = (1 << width) - 1
    vector, done = full, 0
    for i, value in enumerate(b.tolist()):
        if i:
            done += not vector & 1
            vector = (vector >> 1) | (1 << (width - 1))
        found = places.get(value)
        if found is None:
            continue
        low = i - band
        match = 0
        for place in found[bisect_left(found, low):bisect_left(found, i + band + 1)]:
            match |= 1 << (place - low)
        if match:
            taken = vector & match
            vector = ((vector + taken) | (vector & ~match)) & full
    return done + width - vector.bit_count()


def _increasing(values: list[int]) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for value in values:
        at = bisect_left(tails, value)
        if at == len(tails):
            tails.append(value)
        else:
            tails[at] = value
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the best alignment of two shingle rows matches enough of them."""
    n, m = len(a), len(b)
    needed = _needed(n, m, similarity)
    if needed > min(n, m):
        return False
    band = max(n, m) - needed
    size = min(n, m)
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - size:][::-1] != b[len(b) - size:][::-1]) if size else differ[:0]
    tail = int(differ[0]) if len(differ) else size
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    needed -= head + tail
    if needed <= 0:
        return True
    if needed > min(len(a), len(b)):
        return False
    # bounds: shingles in common at all, and those that occur once in both and stand in order
    left, at_left, times_left = np.unique(a, return_index=True, return_counts=True)
    right, at_right, times_right = np.unique(b, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if int(np.minimum(times_left[i], times_right[j]).sum()) < needed:
        return False
    single = (times_left[i] == 1) & (times_right[j] == 1)
    order = np.argsort(at_left[i[single]])
    if _increasing(at_right[j[single]][order].tolist()) >= needed:
        return True
    return banded_matches(a, b, band) >= needed


def sketch_rows(docs: DataFrame, id_col: str, text_col: str, sketches: int, take: int) -> DataFrame:
    """doc_id, k1, k2, vertex (null without words), size in shingles, sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertex, sizes, rows = [], [], []
            for text in batch.column("text"):
                words = word_hashes(text.as_py() or "")
                if not len(words):
                    vertex.append(None)
                    sizes.append(0)
                    rows.append(None)
                    continue
                shingles = shingle_hashes(words)
                vertex.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                sizes.append(len(shingles))
                rows.append(sketch(shingles, sketches, take).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(vertex, pa.binary()),
                 pa.array(sizes, pa.int32()), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "vertex", "size", "sketches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, vertex binary, size int, sketches array<long>")


def _sequences(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """vertex and its shingle row (32-bit hashes) for the rows `wanted` by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (shingle_hashes(word_hashes(text.as_py() or "")) >> np.uint64(32)).astype("<u4").tobytes()
                for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(rows, pa.binary())], ["vertex", "row"])

    rows = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text"))
    chosen = rows.join(wanted, ["k1", "k2"]).select("vertex", "text")
    # repeated rows have equal keys and texts: one of them is enough
    return chosen.mapInArrow(run, "vertex binary, row binary").dropDuplicates(["vertex"])


def _verified(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                similar(np.frombuffer(x.as_py(), dtype="<u4"), np.frombuffer(y.as_py(), dtype="<u4"), similarity)
                for x, y in zip(batch.column("row_a"), batch.column("row_b"), strict=True)
            ]
            chosen = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            yield chosen

    with_a = pairs.join(sequences.select(F.col("vertex").alias("a"), F.col("row").alias("row_a")), "a")
    with_b = with_a.join(sequences.select(F.col("vertex").alias("b"), F.col("row").alias("row_b")), "b")
    return with_b.select("a", "b", "row_a", "row_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """vertex and root of every vertex with an edge: the smallest vertex of its component.

    Every round takes the smallest label around, then jumps to the label's label; star-shaped
    components need two rounds. Labels are stored between rounds in the shared checkpoint folder.
    """
    both = edges.select(F.col("a").alias("vertex"), F.col("b").alias("other")).union(
        edges.select(F.col("b").alias("vertex"), F.col("a").alias("other"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("vertex").agg(F.min("other").alias("least")).select(
        "vertex", F.least("vertex", "least").alias("root")))
    while True:
        around = both.join(labels.select(F.col("vertex").alias("other"), F.col("root").alias("near")), "other")
        least = around.groupBy("vertex").agg(F.min("near").alias("near"))
        stepped = labels.join(least, "vertex").select("vertex", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("vertex").alias("via"), F.col("root").alias("via_root"))
        following = stepped.join(jump, F.col("root") == F.col("via"), "left").select(
            "vertex", "before", F.least("root", F.coalesce("via_root", "root")).alias("root"))
        following = cut_lineage(following)
        labels = following.select("vertex", "root")
        if following.filter(F.col("before") != F.col("root")).isEmpty():
            return labels


def _centred(members: DataFrame, used: DataFrame | None) -> DataFrame:
    """One pair per vertex: itself and, of the centres of its buckets, the one it meets most often.

    The centre of a bucket is the vertex that meets most others in all its buckets: the original of a family
    shares more with every copy than copies share among themselves. `used` centres do not serve again.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    score = members.join(sizes, "bucket").groupBy("vertex").agg(F.sum("n").alias("score"))
    ranked = members.join(score, "vertex")
    if used is not None:
        ranked = ranked.join(used, "vertex", "left_anti")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("score", "vertex", "root")).alias("centre"))
    met = members.join(centres, "bucket").filter(F.col("centre.root") != F.col("root"))
    often = met.groupBy("vertex", F.col("centre.vertex").alias("b")).agg(F.count("*").alias("n"))
    return often.groupBy("vertex").agg(F.max(F.struct("n", "b")).alias("best")).select(
        F.col("vertex").alias("a"), F.col("best.b").alias("b"))


def _opened(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of vertices of different classes in the same bucket that can be similar by their sizes.

    Classes are paired first and then opened, so members of one class never meet.
    """
    left = rows.select("bucket", F.col("root").alias("root_a"), F.col("vertex").alias("a"), F.col("size").alias("size_a"))
    right = rows.select("bucket", F.col("root").alias("root_b"), F.col("vertex").alias("b"), F.col("size").alias("size_b"))
    roots = rows.select("bucket", F.col("root").alias("root_a")).distinct()
    paired = roots.join(roots.select("bucket", F.col("root_a").alias("root_b")), "bucket").filter("root_a < root_b")
    pairs = paired.join(left, ["bucket", "root_a"]).join(right, ["bucket", "root_b"])
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    return pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _places(row: np.ndarray) -> np.ndarray:
    """Shingles of a row, numbered by their occurrence: a matched shingle of two rows is an equal number in both."""
    return (row.astype(np.int64) << 31) | occurrences(row)


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens.view(np.uint64)) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles falls on each bit: two sets differ by at least as many shingles as bits."""
    at = (mix(tokens.view(np.uint64)) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def _frequencies(sequences: DataFrame) -> np.ndarray:
    """How often the numbered shingles of all rows occur, in counters that several shingles may share.

    They only order shingles: any order that is the same for all rows gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for row in batch.column("row"):
                np.add.at(total, _counter(_places(np.frombuffer(row.as_py(), dtype="<u4"))), 1)
        at = np.flatnonzero(total)
        for low in range(0, len(at), 1 << 16):
            part = at[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["counter", "n"])

    sums = sequences.select("row").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    # never more rows than counters
    table = sums.select("counter", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, dtype=np.int32)
    out[table.column("counter").to_numpy()] = table.column("n").to_numpy()
    return out


def _rare(rows: DataFrame, frequencies: np.ndarray, similarity: float) -> DataFrame:
    """bucket (a numbered shingle), root, vertex, size, rest, parities: the rarest shingles of every vertex.

    `rest` counts the shingles of the vertex from this one on in the order of frequency. A similar text has all but
    (1 - similarity) * size of them, so one of the first that many and one more is shared; a shingle that
    occurs once is shared by nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rests, which, sizes, bits = [], [], [], [], []
            for k, row in enumerate(batch.column("row")):
                tokens = _places(np.frombuffer(row.as_py(), dtype="<u4"))
                n = len(tokens)
                often = frequencies[_counter(tokens)]
                first = min(n, int(n - similarity * n + 1e-6) + 1)
                order = np.lexsort((tokens, often))[:first]
                keep = np.flatnonzero(often[order] > 1)
                parts.append(tokens[order[keep]])
                rests.append(n - keep)
                which.append(np.full(len(keep), k))
                sizes.append(np.full(len(keep), n))
                bits.append(_parities(tokens))
            if not parts:
                continue
            at = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts)), batch.column("root").take(at), batch.column("vertex").take(at),
                 pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(rests).astype(np.int32)),
                 pa.array(bits, pa.list_(pa.int64())).take(at)],
                ["bucket", "root", "vertex", "size", "rest", "parities"])

    return rows.select("vertex", "root", "row").mapInArrow(
        run, "bucket long, root binary, vertex binary, size int, rest int, parities array<long>")


def _sharing(rare: DataFrame, similarity: float) -> DataFrame:
    """Pairs of vertices of different classes that share a rare shingle early enough to be similar.

    Two rows of n and m shingles are similar with at least similarity * (n + m) / (1 + similarity) matches. These are
    all from the rarest shared shingle on, so both rows must have that many left there; and the shingles that the
    parities prove different must leave that many. Classes are paired first, on the best of their members (on the parities
    too where a class has one), and then opened; a shingle of many classes is dealt to several tasks.
    """
    rare = cut_lineage(rare)
    classes = rare.groupBy("bucket", "root").agg(F.min("size").alias("least"), F.max("rest").alias("most"), F.max("size").alias("largest"),
        F.when(F.count("*") == 1, F.max("parities")).alias("parities"))
    met = classes.groupBy("bucket").agg(F.count("*").alias("classes")).filter("classes > 1")
    classes = cut_lineage(classes.join(met, "bucket").withColumn("parts", F.ceil(F.col("classes") / DEALT).cast("int")))
    def side(rows: DataFrame, end: str, names: tuple[str, ...], *keys: str) -> DataFrame:
        return rows.select(*keys, *[F.col(n).alias(f"{n}_{end}") for n in names])

    def enough(low: str, high: str, rest: str) -> Column:
        needed = (F.col(f"{low}_a") + F.col(f"{low}_b")) * (similarity / (1 + similarity)) - 1e-6
        differ = reduce(lambda x, y: x + y, [
            F.bit_count(F.col("parities_a")[k].bitwiseXOR(F.col("parities_b")[k])) for k in range(PARITY_BITS // 64)])
        common = (F.col(f"{high}_a") + F.col(f"{high}_b") - F.coalesce(differ, F.lit(0))) / 2
        return (F.least(f"{rest}_a", f"{rest}_b") >= needed) & (common >= needed)

    names = ("root", "least", "most", "largest", "parities")
    one = side(classes.withColumn("part", F.pmod(F.xxhash64("root"), "parts").cast("int")), "a", names, "bucket", "part")
    other = side(classes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b", names, "bucket", "part")
    paired = one.join(other, ["bucket", "part"]).filter(
        (F.col("root_a") < F.col("root_b")) & enough("least", "largest", "most")).select("bucket", "root_a", "root_b")
    names = ("root", "vertex", "size", "rest", "parities")
    pairs = paired.join(side(rare, "a", names, "bucket"), ["bucket", "root_a"]).join(
        side(rare, "b", names, "bucket"), ["bucket", "root_b"])
    return pairs.filter(enough("size", "size", "rest")).select(
        F.least("vertex_a", "vertex_b").alias("a"), F.greatest("vertex_a", "vertex_b").alias("b"))


def _crossing(members: DataFrame, sequences: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Pairs of vertices of different classes with a sketch in common that can be similar.

    All of them in buckets of at most `crowd` classes. Where a sketch brings more classes together (a passage
    that very many texts share) it says little; vertices of such buckets meet by their rarest shingles instead,
    which no similar pair escapes.
    """
    classes = members.select("bucket", "root").distinct().groupBy("bucket").agg(F.count("*").alias("classes"))
    rows = cut_lineage(members.join(classes.filter("classes > 1"), "bucket"))
    few, many = rows.filter(F.col("classes") <= crowd), rows.filter(F.col("classes") > crowd)
    pairs = _opened(few, similarity)
    crowded = many.select("vertex", "root").distinct()
    if not many.isEmpty():
        rare = _rare(crowded.join(sequences, "vertex"), _frequencies(sequences), similarity)
        pairs = pairs.unionByName(_sharing(rare, similarity))
    return pairs.distinct()


def _led(members: DataFrame, edges: DataFrame) -> DataFrame:
    """`members` with the centre that a vertex is linked to as root, or that centre's own centre, and so on.

    Edges lead from each vertex to a centre with more meetings, so there are no circles. Chains are followed
    over four steps; a class that stays split further only brings more comparisons.
    """
    labels = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    for _ in range(2):
        via = labels.select(F.col("vertex").alias("root"), F.col("root").alias("further"))
        labels = cut_lineage(labels.join(via, "root", "left").select("vertex", F.coalesce("further", "root").alias("root")))
    return members.drop("root").join(labels, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))


def near_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketches: int = SKETCHES, take: int = TAKE,
    similarity: float = SIMILARITY, crowd: int = CROWD,
) -> DataFrame:
    """One row per document: doc_id, k1, k2, class key `root`, class_id (smallest doc_id), class_size, kept.

    `kept` marks the document whose id the class has; repeated rows of that document are all marked.
    """
    small_batches(docs.sparkSession)
    rows = cut_lineage(sketch_rows(docs, id_col, text_col, sketches, take))
    vertices = rows.filter(F.col("vertex").isNotNull()).groupBy("vertex").agg(
        F.min(F.struct("k1", "k2", "size", "sketches")).alias("one")).select("vertex", "one.*")
    vertices = cut_lineage(vertices)
    buckets = vertices.select("vertex", "size", F.explode("sketches").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = cut_lineage(buckets.join(crowded, "bucket").withColumn("root", F.col("vertex")))
    wanted = vertices.join(members.select("vertex").distinct(), "vertex").select("k1", "k2", "vertex")
    sequences = cut_lineage(_sequences(docs, id_col, text_col, wanted))
    # first to one centre; what is linked then meets its own class no more
    first = cut_lineage(_centred(members, None))
    linked = cut_lineage(_verified(first, sequences, similarity))
    members = cut_lineage(_led(members, linked))
    second = _centred(members, first.select(F.col("b").alias("vertex")).distinct()).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = second.unionByName(_crossing(members, sequences, similarity, crowd)).distinct()
    roots = components(linked.unionByName(_verified(more, sequences, similarity)))
    classed = rows.join(roots, "vertex", "left").select(
        "doc_id", "k1", "k2",
        # copies share a vertex; texts without words stay alone under their own key
        F.coalesce("root", "vertex", F.concat(F.lit("row:"), F.col("k1"), F.lit(":"), F.col("k2")).cast("binary")).alias("root"))
    sums = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
                                       F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    return classed.join(sums, "root").select(
        "doc_id", "k1", "k2", "root", "class_id", "class_size",
        ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class, all columns kept; of repeated rows one stays."""
    kept = near_classes(docs, **settings).filter("kept").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    one, two = row_keys("doc_id", "text")
    keyed = docs.select("*", one.alias("__k1"), two.alias("__k2"))
    return keyed.join(kept, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")


