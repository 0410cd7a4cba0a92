"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Among all document rates w whose expected tokens meet the target, the one
nearest to "every document once" (smallest sum of w log w - w + 1) under 0 <= w <= `most` is an exponential
tilt, w = min(most, exp(lambda * size)). lambda is the source's dual variable: the root of the gradient of a
convex function, found by Newton steps kept inside a bracket. A rate depends on source and size alone, so
steps aggregate the table of distinct (source, size), which grows with sources and lengths and not with
documents; all sources step at once, and the driver sees one number per step, the largest error.

Rates become copies by one threshold per source: a document takes floor(rate) copies, and one more where its
hash lies below its fraction shifted by the threshold that brings the source nearest to its target. The
threshold is found from sums over bins of that distance; only the documents of the bin that holds it are put in
order. What is left is at most half of one document, and `NUDGES` documents of a source, the best fitting ones,
then gain or lose a copy. No copy count is further than one from its rate.

Targets: sources by code point (null last) weigh 1, 2, 3, 1, ... of all words; a target stops at `most` times its
source, and what is over is shared again by weight.

Defined results: a null text has no words; documents without words take nothing; a null source is a source of its own;
rows equal in id, source and text are one document with several copies, each of which may be taken or
not; a null id is an id like any other; an empty table, or one without any word, takes nothing (targets 0); a
source whose target is its cap takes every document `most` times; other columns are not read. Reruns agree: hashes
come from id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.ranks import placed
from logloom.llm.text import whole, words
from logloom.operators.skew import lookup_join
from logloom.session import cut_lineage

MOST = 3
WEIGHTS = (1, 2, 3)
BINS = 8192
NUDGES = 2
TOLERANCE = 1e-9
MAX_STEPS = 80


def measured(documents: DataFrame) -> DataFrame:
    """Documents as (source struct, doc_id, size, spot, copies): rows equal in all of it are counted, not repeated."""
    slim = documents.select(
        F.struct("source").alias("source"), "doc_id", F.size(words(whole("text"))).cast("bigint").alias("size"),
        F.xxhash64(F.struct("doc_id"), whole("text")).alias("spot"))
    return slim.groupBy("source", "doc_id", "size", "spot").agg(F.count("*").alias("copies"))


def water_level(sources: DataFrame, most: float) -> float:
    """The level at which min(cap, level * weight) sums to all sizes, where cap is `most` times a source.

    Every round fixes the sources above the level and shares the rest again; the driver holds three sums.
    """
    cap = F.col("source_size") * F.lit(float(most))
    level, above = None, 0
    while True:
        over = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(over).alias("above")).first()
        if not row["weight"] or (level is not None and row["above"] == above):
            return level or 0.0
        level, above = (row["all"] - most * row["fixed"]) / row["weight"], row["above"]


def with_targets(docs: DataFrame, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources with source_size, weight and target."""
    totals = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("source_size"))
    ranked = placed(totals.withColumn("all", F.lit(0)), ["all"], [F.col("source.source").isNull(), F.col("source.source")])
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut_lineage(ranked.select("source", "source_size", dealt.alias("weight")))
    level = water_level(sources, most)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.lit(float(level)) * F.col("weight"))
    return sources.withColumn("target", target.cast("double"))


def exact_sum(value: Column) -> Column:
    """Sum of doubles to twelve places; decimals add up to the same in any order, so reruns agree to the last bit."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def tilted(docs: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = TOLERANCE,
           max_steps: int = MAX_STEPS) -> DataFrame:
    """`targets` with `tilt`, the exponent per word (null where every document stands at `most`)."""
    counts = docs.filter("size > 0").groupBy("source", "size").agg(F.sum("copies").alias("docs"))
    shape = counts.groupBy("source").agg(
        F.min("size").alias("least"), (exact_sum(F.col("docs") * F.col("size").cast("double") * F.col("size")) / F.sum(F.col("docs") * F.col("size"))).alias("typical"))
    open_ = (F.col("target") < F.col("source_size") * F.lit(most * (1 - 1e-12))) & (F.col("target") > 0)
    share = F.log(F.col("target") / F.col("source_size"))
    start = targets.filter(open_).join(shape, "source").withColumn("share", share).select(
        "source", "target",
        # by convexity the root of a shrinking source lies below share / typical and above share / least;
        # a growing one lies between 0 and the tilt at which its shortest document stands at the cap
        F.when(F.col("share") < 0, F.col("share") / F.col("least")).otherwise(F.lit(0.0)).alias("low"),
        F.when(F.col("share") < 0, F.col("share") / F.col("typical")).otherwise(F.lit(math.log(most)) / F.col("least")).alias("high"),
        (F.col("share") / F.col("typical")).alias("tilt"))
    state = cut_lineage(start)
    table = cut_lineage(counts)
    power = F.least(F.col("tilt") * F.col("size"), F.lit(math.log(most)))
    mass = F.col("docs") * F.col("size") * F.exp(power)
    free = F.col("tilt") * F.col("size") < F.lit(math.log(most))
    for _ in range(max_steps):
        sums = lookup_join(table, state, ["source"], sized_by=targets).groupBy("source").agg(
            F.first("target").alias("target"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("tilt").alias("tilt"),
            exact_sum(mass).alias("value"), exact_sum(F.when(free, mass * F.col("size")).otherwise(0.0)).alias("slope"))
        gap = F.col("value") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        near = F.abs(gap) <= F.lit(tolerance) * F.col("target")
        newton = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        stepped = F.when(near, F.col("tilt")).when((newton >= low) & (newton <= high), newton).otherwise((low + high) / 2)
        # a bracket without a number in between cannot get nearer
        stuck = near | (high - low <= F.abs(high) * 1e-15)
        state = cut_lineage(sums.select("source", "target", low.alias("low"), high.alias("high"), stepped.alias("tilt"), stuck.alias("done")))
        if state.agg(F.min("done")).first()[0] in (None, True):
            break
    return targets.join(state.select("source", "tilt"), "source", "left")


def rates(docs: DataFrame, tilts: DataFrame, most: float = MOST) -> DataFrame:
    """Every document's rate, 0 to `most`; documents without words and sources without a target have none."""
    rate = F.when((F.col("size") == 0) | (F.col("target") == 0), F.lit(0.0)).when(
        F.col("tilt").isNull(), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(most))))))
    return lookup_join(docs, tilts, ["source"]).withColumn("rate", rate)


def rounded(rated: DataFrame, targets: DataFrame, bins: int = BINS, nudges: int = NUDGES) -> DataFrame:
    """`rated` with `base`, copies that every one of its rows takes, and `extra`, how many of them take one more."""
    # 53 bits of the hash as a number from 0 to 1
    chance = F.shiftrightunsigned(F.col("spot"), 11) / F.lit(float(1 << 53))
    base = F.floor(F.col("rate")).cast("bigint")
    order = chance - (F.col("rate") - base)
    may = F.col("rate") > base
    words_of = F.col("size") * F.col("copies")
    rows = cut_lineage(rated.select(
        "source", "doc_id", "size", "spot", "copies", "rate", "source_size", "target", base.alias("base"), may.alias("may"),
        order.alias("distance"), F.floor((order + 1) * F.lit(bins / 2)).cast("int").alias("bin")))
    fixed = rows.groupBy("source").agg(
        F.first("target").alias("wanted"), F.sum(F.col("base") * words_of).alias("sure"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.filter("may").groupBy("source", "bin").agg(F.sum(words_of).alias("own")).join(fixed, "source")
    # the bin that holds the threshold: the last one that starts below what is wanted
    edge = sums.withColumn("before", F.col("sure") + F.sum("own").over(upto) - F.col("own")).filter(
        F.col("before") < F.col("wanted")).groupBy("source").agg(
        F.max_by(F.struct("bin", "before"), "bin").alias("edge"))
    placed_rows = lookup_join(rows, edge, ["source"], how="left", sized_by=targets)
    inside = F.col("may") & (F.col("bin") == F.col("edge.bin"))
    below = F.col("may") & (F.col("bin") < F.col("edge.bin"))
    running = Window.partitionBy("source").orderBy("distance", "spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    tight = placed_rows.filter(inside).withColumn("total", F.col("edge.before") + F.sum(words_of).over(running) - words_of)
    # of equal rows as many as come nearest
    part = F.greatest(F.lit(0), F.least(F.col("copies"), F.round((F.col("target") - F.col("total")) / F.col("size")))).cast("bigint")
    rest = placed_rows.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        "extra", F.when(F.coalesce(below, F.lit(False)), F.col("copies")).otherwise(F.lit(0)).cast("bigint"))
    names = [*rows.columns, "extra"]
    done = cut_lineage(rest.select(*names).unionByName(tight.withColumn("extra", part).select(*names)))
    for _ in range(nudges):
        done = nudged(done, targets)
    return done


def nudged(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One document per source gains or loses a copy, where that brings the source nearer to its target."""
    taken = F.col("size") * (F.col("base") * F.col("copies") + F.col("extra"))
    gaps = rows.groupBy("source").agg((F.first("target") - F.sum(taken)).alias("gap"))
    able = F.col("may") & F.when(F.col("gap") > 0, F.col("extra") < F.col("copies")).otherwise(F.col("extra") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    picks = lookup_join(rows, gaps, ["source"], sized_by=targets).filter(able & (miss < F.abs("gap"))).groupBy("source").agg(
        F.min(F.struct(miss.alias("miss"), "spot", "size", F.struct("doc_id").alias("id"), F.signum("gap").cast("bigint").alias("move"))).alias("pick"))
    hit = (F.col("spot") == F.col("pick.spot")) & (F.col("size") == F.col("pick.size")) & (F.struct("doc_id") == F.col("pick.id"))
    moved = lookup_join(rows, picks, ["source"], how="left", sized_by=targets).withColumn(
        "extra", F.col("extra") + F.when(F.coalesce(hit, F.lit(False)), F.col("pick.move")).otherwise(F.lit(0)))
    return cut_lineage(moved.drop("pick"))


def mix(documents: DataFrame, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Every row of `documents` with its rate and copies: doc_id, source, size, source_size, target, rate, times, taken."""
    docs = cut_lineage(measured(documents))
    tilts = cut_lineage(tilted(docs, with_targets(docs, most, weights), most))
    done = rounded(rates(docs, tilts, most), tilts)
    # rows counted together come apart again; the first `extra` of them take one copy more
    each = done.select(
        "doc_id", F.col("source.source").alias("source"), "size", "source_size", "target", "rate", "base", "extra",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("nth"))
    times = F.col("base") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", times.cast("bigint").alias("times"),
                       (times * F.col("size")).cast("bigint").alias("taken"))
