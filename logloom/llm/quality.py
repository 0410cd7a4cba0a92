"""Quality rules: a decision list learned by sequential covering, applied as Spark conditionals.

A rule is a conjunction of thresholds on text statistics. Rules are grown condition by condition
on one part of the labelled rows, cut back on the other part, and kept only while they stay
precise there. All counts come from Spark aggregations over the labelled rows; the driver sees
one small table of (feature, bin) counts per step. The list becomes one CASE expression.

Defined results: a null text is an empty text (no words, fails the base rules); repeated rows are
judged one by one; an empty labels table gives an empty list, so only the base rules decide; other
columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import BLANKS, let, whole, words
from logloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _repeat_words(array: Column) -> Column:
    """Words inside three-word windows that occur at least twice, counted once per position.

    Window hashes are sorted with their positions, so equal windows are neighbours; the starts of
    repeated windows are then walked in order and each adds at most three words.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(array) - F.lit(WINDOW)),
        lambda i: F.xxhash64(F.get(array, i), F.get(array, i + 1), F.get(array, i + 2)),
    )

    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
        let(starts(h), covered)))
    return F.when(F.size(array) < WINDOW, F.lit(0).cast("bigint")).otherwise(counted)


def _removed(text: Column, pattern: str) -> Column:
    """How many characters a pattern of single characters matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base statistics and the features rules may use, one row per document, no shuffle."""
    base = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "doc_id",
        F.length(F.translate("t", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        let(words(F.col("t")), lambda w: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("repeat"),
        )).alias("w"),
        _removed(F.col("t"), r"\p{Lu}").alias("upper"),
        _removed(F.col("t"), r"\p{L}").alias("letters"),
        _removed(F.col("t"), r"\p{N}").alias("digits"),
        _removed(F.col("t"), r"[.!?]").alias("ends"),
    )
    per_word = F.greatest(F.col("w.n"), F.lit(1)).cast("double")
    return counted.select(
        "doc_id",
        F.col("w.n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").cast("bigint").alias("n_dup_lines"),
        F.col("w.repeat").cast("bigint").alias("n_repeat_words"),
        F.col("w.n").cast("double").alias("f_words"),
        (F.col("word_chars") / per_word).alias("f_word_length"),
        (F.col("n_symbols") / per_word).alias("f_symbols"),
        (F.col("l.dup") / F.greatest(F.col("l.lines"), F.lit(1))).alias("f_dup_lines"),
        (F.col("w.repeat") / per_word).alias("f_repeat"),
        (F.col("w.distinct") / per_word).alias("f_distinct"),
        (F.col("upper") / F.greatest(F.col("letters"), F.lit(1))).alias("f_upper"),
        (F.col("letters") / F.greatest(F.col("word_chars"), F.lit(1))).alias("f_letters"),
        (F.col("digits") / F.greatest(F.col("word_chars"), F.lit(1))).alias("f_digits"),
        (F.col("ends") / per_word).alias("f_ends"),
    )


FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeat", "f_distinct", "f_upper", "f_letters",
            "f_digits", "f_ends")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """Statistics and label of at most `sample_rows` labelled documents, picked by a hash of the id."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        .select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    )
    # the sample is bounded by its parameter, so it may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    marked = joined.select(F.struct("doc_id", "bad").alias("doc_id"), "text")
    return text_stats(marked).select(
        F.col("doc_id.bad").alias("bad"),
        (F.pmod(F.xxhash64("doc_id.doc_id", F.lit("part")), F.lit(3)) < 2).alias("grow"),
        *FEATURES,
    )


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[float, int, int]]]:
    """Per feature the label counts of the grow part in each bin, lowest bin first."""
    bins = [
        F.struct(
            F.lit(name).alias("feature"),
            sum((F.col(name) > F.lit(c)).cast("int") for c in cut).alias("bin"),
        )
        for name, cut in cuts.items()
    ]
    found = (
        rows.filter("grow").select("bad", F.explode(F.array(*bins)).alias("b"))
        .groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    )
    table: dict[str, list[tuple[float, int, int]]] = {name: [] for name in cuts}
    for row in sorted(found, key=lambda r: (r["feature"], r["bin"])):
        table[row["feature"]].append((row["bin"], row["bad"], row["n"] - row["bad"]))
    return table


def _information(bad: int, good: int) -> float:
    from math import log2

    return log2(bad / (bad + good)) if bad else float("-inf")


def _best(table: dict[str, list[tuple[float, int, int]]], cuts: dict[str, list[float]], least: int) -> Condition | None:
    """The condition with the largest information gain times covered bad rows."""
    best, choice = 1e-9, None
    for name, rows in table.items():
        bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not bad:
            return None
        before = _information(bad, good)
        for k, cut in enumerate(cuts[name]):
            low_bad, low_good = (sum(r[j] for r in rows if r[0] <= k) for j in (1, 2))
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p < least or p + n == bad + good:
                    continue
                gain = p * (_information(p, n) - before)
                if gain > best:
                    best, choice = gain, Condition(name, above, cut)
    return choice


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def learn_rules(
    sample: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 24,
    min_precision: float = 0.9, min_covered: int = 5,
) -> list[Rule]:
    """Ordered rules for bad rows. `sample` has `bad`, `grow` and the features; it is read often, so store it."""
    fractions = [i / bins for i in range(1, bins)]
    row = sample.agg(*[F.percentile_approx(name, fractions, 1000).alias(name) for name in FEATURES]).first()
    cuts = {name: sorted({float(x) for x in row[name]}) for name in FEATURES if row[name]}
    rules: list[Rule] = []
    left = sample
    while cuts and len(rules) < max_rules:
        rule: Rule = ()
        inside = left
        while len(rule) < max_conditions:
            table = _counts(inside, cuts)
            some = next((t for t in table.values() if t), [])
            if not sum(r[2] for r in some):  # nothing good is left inside
                break
            condition = _best(table, cuts, min_covered)
            if condition is None:
                break
            rule += (condition,)
            inside = inside.filter(condition.column())
        if not rule:
            break
        rule = _pruned(left, rule, min_precision, min_covered)
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~_holds(rule))
    return rules


def _pruned(left: DataFrame, rule: Rule, min_precision: float, min_covered: int) -> Rule:
    """The best prefix of the rule on the prune part; none if no prefix is precise on both parts."""
    sums = []
    for k in range(1, len(rule) + 1):
        inside = _holds(rule[:k])
        for part, name in ((F.col("grow"), "g"), (~F.col("grow"), "p")):
            sums += [
                F.coalesce(F.sum((inside & part & (F.col("bad") == b)).cast("int")), F.lit(0)).alias(f"{name}{b}{k}")
                for b in (0, 1)
            ]
    row = left.agg(*sums).first()
    best, choice = -1.0, ()
    for k in range(1, len(rule) + 1):
        bad, good = row[f"p1{k}"], row[f"p0{k}"]
        all_bad, all_good = bad + row[f"g1{k}"], good + row[f"g0{k}"]
        if all_bad < min_covered or all_bad < min_precision * (all_bad + all_good) or bad < min_precision * (bad + good):
            continue
        value = (bad - good) / (bad + good) * bad if bad + good else 0.0
        if value > best:
            best, choice = value, rule[:k]
    return choice


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1 on; 0 where none does."""
    out: Column = F
    for number, rule in enumerate(rules, 1):
        out = out.when(_holds(rule), F.lit(number))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, **learning) -> DataFrame:
    """Base statistics, the rule that fired and whether the document stays.

    Learning reads at most `sample_rows` labelled documents; applying reads all documents.
    """
    rules = learn_rules(cut_lineage(labelled_sample(docs, labels, sample_rows)), **learning)
    return apply_rules(docs, rules)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    judged = text_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )
