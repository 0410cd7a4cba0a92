"""Benchmark decontamination by spaced seeds.

A mask such as `11010011011` hashes the tokens under its ones and ignores the rest, so a hit
survives substitutions at ignored places. Hashes of all benchmark items meet hashes at every
position of every document; around each hit the two token rows are laid side by side without gaps
and the share of equal tokens in a window decides.

The seed table is broadcast only while the benchmark's text is at most `broadcast_chars` long;
beyond that hits are found by a shuffled join of (hash, position) rows and the tokens are fetched
by document afterwards.

Items shorter than the shortest mask carry no seed. They are matched token by token, by a hash of the
whole item: anywhere in a document if they have SHORTEST tokens or more, and below that (a word or
two, which clean texts hold too) only where the item is the whole document.

Defined results: null or empty texts match nothing; repeated documents are each compared, but the
result has one row per (doc_id, item_id), and a place hit by several masks or copies counts once in
n_hits; items with equal text are all reported; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import seeds, tokens, whole
from logloom.operators.skew import fits
from logloom.session import cut_lineage

MASKS = ("11010011011", "1100101011", "11101110001")
WINDOW = 16
SIMILARITY = 0.8
BROADCAST_CHARS = 8_000_000
SHORTEST = 5
FOUND_ROWS = 250_000


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(
        F.col(item_col).alias("item_id"), tokens(whole(text_col)).alias("item")
    ).filter(F.col("item_id").isNotNull())


def _item_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(seed, item_id, item_at), each once: a seed repeated inside an item keeps all its places."""
    found = seeds(items, "item", masks, "item_at", "seed")
    return found.filter(F.col("seed").isNotNull()).select("seed", "item_id", "item_at").distinct()


def _windows(hits: DataFrame, places: list[str], span: int, window: int) -> DataFrame:
    """`places` and (start, length, equal) of the window around each hit, in document positions.

    The window lies inside the overlap of both token rows and is centred on the seed where it can be.
    Only the window's tokens leave the row of the hit: a stage keeps all hits of a document until it hands them on,
    so whole token rows beside each hit would take the square of a document's length. The generator keeps
    conditions on the window from being moved below it; nothing after it needs a lambda, so hits that fail go at once.
    """
    shift = F.col("at") - F.col("item_at")
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size("item"), F.size("tokens") - shift)
    start = F.greatest(low, F.least(F.col("item_at") - F.lit((window - span) // 2), high - window))
    bounds = hits.select(*places, "tokens", "item", shift.alias("shift"), start.alias("from"), high.alias("high"))
    length = F.least(F.col("high") - F.col("from"), F.lit(window))
    cut = bounds.select(*places, F.explode(F.array(F.struct(
        (F.col("from") + F.col("shift")).alias("start"), length.alias("length"),
        F.slice("tokens", F.col("from") + F.col("shift") + 1, length).alias("part"),
        F.slice("item", F.col("from") + 1, length).alias("passage"),
    ))).alias("w")).select(*places, "w.*")
    same = [
        F.when((F.col("length") > j) & F.get("part", F.lit(j)).eqNullSafe(F.get("passage", F.lit(j))), 1).otherwise(0)
        for j in range(window)
    ]
    return cut.select(*places, "start", "length", sum(same[1:], same[0]).alias("equal"))


def _short_hits(rows: DataFrame, items: DataFrame, span: int, shortest: int, small: bool) -> DataFrame | None:
    """Places where an item of less than `span` tokens stands word for word; None if there is no such item.

    Only the lengths that occur among the items (less than `span` values) are cut out of the documents.
    """
    short = items.filter((F.size("item") > 0) & (F.size("item") < span)).withColumn("seed", F.xxhash64("item"))
    lengths = sorted(r[0] for r in short.select(F.size("item")).distinct().collect())
    if not lengths:
        return None
    size = F.size("tokens")
    fitting = rows.select("doc_id", "tokens", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length")).filter(
        F.when(F.col("length") < shortest, size == F.col("length")).otherwise(size >= F.col("length")))
    parts = fitting.select(
        "doc_id", "length", "tokens", F.explode(F.sequence(F.lit(0), size - F.col("length"))).alias("at")
    ).select("doc_id", "length", "at", F.slice("tokens", F.col("at") + 1, F.col("length")).alias("part"))
    met = parts.withColumn("seed", F.xxhash64("part")).join(F.broadcast(short) if small else short, "seed")
    return met.filter(F.col("part") == F.col("item")).select(
        "doc_id", "item_id", "at", F.lit(0).alias("item_at"), F.col("at").alias("start"), "length",
        F.col("length").alias("equal"))


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
    window: int = WINDOW, similarity: float = SIMILARITY, broadcast_chars: int = BROADCAST_CHARS,
    shortest: int = SHORTEST,
) -> DataFrame:
    """Documents that share a passage with an item: doc_id, item_id, hits, the best window.

    A window has `window` tokens, fewer only where the item or the document is shorter there, and
    never fewer than the shortest mask, but for items that are shorter than it themselves.
    """
    span = min(map(len, masks))
    items = _items(benchmark, item_col, item_text_col)
    item_seeds = _item_seeds(items, masks)
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(whole(text_col)).alias("tokens"))
    chars = benchmark.agg(F.coalesce(F.sum(F.length(item_text_col)), F.lit(0))).first()[0]
    positions = seeds(rows, "tokens", masks, "at", "seed")
    small = chars <= broadcast_chars
    short = _short_hits(rows, items, span, shortest, small)
    if small:
        # joining right behind the generator keeps the token array a reference inside the stage
        hits = positions.join(F.broadcast(item_seeds), "seed").join(F.broadcast(items), "item_id")
    else:
        rows = rows.withColumn("text_key", F.xxhash64("tokens"))
        thin = seeds(rows, "tokens", masks, "at", "seed").select("doc_id", "text_key", "at", "seed")
        met = thin.join(item_seeds, "seed").select(
            F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "at", "item_id", "item_at"
        ).dropDuplicates(["hit_id", "hit_key", "at", "item_id", "item_at"])
        # items first: the tokens of a document are cut to the window right behind the join that brings them
        hits = met.join(items, "item_id").join(
            rows, F.col("hit_id").eqNullSafe(F.col("doc_id")) & (F.col("hit_key") == F.col("text_key")))
    places = ["doc_id", "item_id", "at", "item_at"]
    scored = _windows(hits, places, span, window)
    enough = scored.filter((F.col("length") >= span) & (F.col("equal") >= F.lit(similarity) * F.col("length")))
    if short is not None:
        enough = enough.unionByName(short)
    return enough.groupBy("doc_id", "item_id").agg(
        F.count_distinct("at", "item_at").alias("n_hits"),
        F.max(F.struct(F.col("equal").alias("equal"), (-F.col("start")).alias("start"), F.col("length").alias("length"))).alias("best"),
        F.min("start").cast("bigint").alias("first_token"),
        F.max(F.col("start") + F.col("length")).cast("bigint").alias("last_token"),
    ).select(
        "doc_id", "item_id", "n_hits", "first_token", "last_token",
        F.col("best.equal").cast("bigint").alias("best_equal"), F.col("best.length").cast("bigint").alias("best_length"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without a benchmark passage, all their columns kept.

    Overlaps are found under a key of id and text, so repeated ids with other texts are judged apart. Few documents
    go, so their keys are stored and, up to FOUND_ROWS, broadcast: whole documents are shuffled only beyond that.
    """
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64(whole("text")).alias("text_key")).alias("key"), "text")
    found = cut_lineage(find_overlaps(keyed, benchmark, id_col="key", **settings).select(
        F.col("doc_id.doc_id").alias("found_id"), F.col("doc_id.text_key").alias("found_key")).distinct())
    same = docs["doc_id"].eqNullSafe(found["found_id"]) & (F.xxhash64(whole(docs["text"])) == found["found_key"])
    return docs.join(F.broadcast(found) if fits(found, FOUND_ROWS) else found, same, "left_anti")
