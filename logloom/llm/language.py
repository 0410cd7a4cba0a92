"""Language ID by Bayesian evidence fusion.

The posterior of a row multiplies the likelihood of its text (byte trigrams), the likelihood of the
language its markup or record declares, the likelihood of the language in its address, and a prior
of its host. Host priors are counts of text-only posteriors, summed by grouped aggregation per host,
and smoothed towards the host's domain, that towards the address suffix, that towards all rows; a row's own share is
taken out of its host's count. How far a declaration can be trusted is counted too: the table
P(declared | language) comes from one aggregation over all rows.

The trigram model is fitted on labelled rows picked by a hash of their id, for every language the same
number at most: `train_rows` divided by the number of languages, and not under EACH. So a rare
language is learned beside one that labels nearly all rows. Counts and priors cover all rows. Texts are read whole.

Defined results: null, empty and letterless texts have no text likelihood; they get the language the
other evidence favours and are not accepted. Unknown or null declarations, addresses and hosts say
nothing. Ties go to the first language by name. Repeated rows are judged one by one. Without
training rows there is no language: lang is null and nothing is accepted. Columns of the input are
kept; the result is added as one struct column, whose name the caller picks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import small_batches
from logloom.session import cut_lineage

BUCKETS = 1 << 14
CHUNK = 1_000_000  # bytes of text scored at once inside a batch
EVIDENCE = 60.0  # trigrams a text counts for at most, so that other evidence keeps a say
EACH = 50  # rows to learn from that every language may have, however many languages there are
KAPPA = 20.0  # rows of the wider group that a prior is smoothed with
MAX_HOSTS = 200_000  # host priors are broadcast up to this number, joined by shuffle beyond
# bytes that are no letters become blanks; bytes of multi-byte characters stay
_KEEP = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts in one array and where each text starts (with one end mark)."""
    raw = [f" {t.lower()} ".encode("utf-8", "ignore").translate(_KEEP) for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=starts[1:])
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(raw) + 1, dtype=np.int64)
    mixed = data[:-2] * np.uint32(40503) + data[1:-1] * np.uint32(3121) + data[2:] * np.uint32(179)
    return (mixed & np.uint32(BUCKETS - 1)).astype(np.int64), np.minimum(starts, len(mixed))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, cut into lists of bounded size; a longer text is a list of its own."""
    chunk: list[str] = []
    size = 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


@dataclass(frozen=True)
class Model:
    """Languages and the log probability of every trigram bucket per language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihoods of the texts, relative to the best language; zeros for texts without letters."""
        return self.judge(texts)[0]

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the texts, and which texts have letters: relative scores do not tell with one language."""
        out, has = [], []
        for chunk in _chunks([t or "" for t in texts]):
            grams, starts = _trigrams(chunk)
            counts = np.diff(starts)
            scores = np.zeros((len(chunk), len(self.languages)))
            some = counts > 0
            if some.any():
                for k in range(len(self.languages)):
                    running = np.concatenate(([0.0], np.cumsum(self.table[k][grams], dtype=np.float64)))
                    scores[:, k] = running[starts[1:]] - running[starts[:-1]]
            lettered = np.array([any(c.isalpha() for c in t) for t in chunk], dtype=bool)
            lettered &= some
            weight = np.where(lettered, np.minimum(counts, EVIDENCE) / np.maximum(counts, 1), 0.0)
            scores *= weight[:, None]
            out.append(scores - scores.max(axis=1, keepdims=True))
            has.append(lettered)
        if not out:
            return np.zeros((0, len(self.languages))), np.zeros(0, dtype=bool)
        return np.concatenate(out), np.concatenate(has)


def train(rows: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = 4000, least: int = 5) -> Model:
    """Trigram model of the languages that at least `least` rows are labelled with."""
    small_batches(rows.sparkSession)
    labelled = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(label_col).alias("label"))
    labelled = labelled.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    ids = cut_lineage(labelled.groupBy("id").agg(F.min("label").alias("label")))
    known = cut_lineage(ids.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("label"))
    each = max(train_rows // max(known.count(), 1), EACH)
    # every partition leaves out ranks above the bound before the exchange, so a language's task gets at most `each`
    # ids of each partition; a join that deals by label would come before that, so the few labels are broadcast
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = ids.join(F.broadcast(known), "label", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= each).select("id", "label")
    # bounded per language, so it may be broadcast
    sample = labelled.join(F.broadcast(chosen), ["id", "label"]).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, _ = _trigrams([text])
                sums[label] = sums.get(label, 0) + np.bincount(grams, minlength=BUCKETS)
                seen[label] = seen.get(label, 0) + 1
        for label, total in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen[label]))],
                ["label", "bucket", "n"])

    found = sample.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    rows_ = found.collect()  # at most BUCKETS + 1 rows per language
    docs = {r["label"]: r["n"] for r in rows_ if r["bucket"] == -1}
    languages = tuple(sorted(k for k, n in docs.items() if n >= least))
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in rows_:
        if r["bucket"] >= 0 and r["label"] in languages:
            table[languages.index(r["label"]), r["bucket"]] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if languages else table)


def _code(value: Column, languages: tuple[str, ...]) -> Column:
    """The primary subtag of a language tag, null unless the model knows it."""
    tag = F.regexp_extract(F.lower(F.coalesce(value, F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(tag.isin(*languages), tag)


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z][A-Za-z_-]*)", 1)


def markup_text(html: Column) -> Column:
    """The text of a page for counting letters: no scripts, styles, tags or references."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@\s]*@)?([^/:?#\s]+)", 1))


def address_language(url: Column) -> Column:
    """A path segment that looks like a language tag, the first one."""
    return F.regexp_extract(url, r"://[^/?#\s]+/([A-Za-z]{2,3}(?:-[A-Za-z]{2})?)(?:[/?#]|$)", 1)


def _domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]*)$", 0)


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+)$", 1)


def _scorer(model: Model):
    @F.pandas_udf("scores array<double>, lettered boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        scores, lettered = model.judge([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"scores": list(scores), "lettered": lettered})

    return score


def _posterior(scores: Column, size: int) -> list[Column]:
    weights = [F.exp(scores[k]) for k in range(size)]
    total = reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]


def _smoothed(counts: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Smoothed priors: counts per first key, smoothed by those of the second key, and so on up to all rows."""
    names = [f"n{k}" for k in range(size)]

    def summed(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])

    levels = [counts]
    for i in range(1, len(keys)):
        levels.append(summed(levels[-1], list(keys[i:])))
    total = levels[-1].agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]).first()
    whole = sum(total[n] for n in names)
    wider = [F.lit((total[n] + 1.0) / (whole + size)) for n in names]
    priors = None
    for i in range(len(keys) - 1, 0, -1):
        rows, key = levels[i], keys[i]
        if priors is not None:
            rows = rows.join(priors, keys[i + 1], "left")
            wider = [F.col(f"p{k}") for k in range(size)]
        mass = reduce(lambda a, b: a + b, [F.col(n) for n in names])
        priors = rows.select(key, *[((F.col(n) + KAPPA * wider[k]) / (mass + KAPPA)).alias(f"p{k}") for k, n in enumerate(names)])
    return counts.join(priors, keys[1], "left")


def identify(
    rows: DataFrame, model: Model, *, text_col: str, declared: Column | None = None, address: Column | None = None,
    host: Column | None = None, out: str = "language", confidence: float = 0.5, max_hosts: int = MAX_HOSTS,
) -> DataFrame:
    """`rows` with a struct `out`: lang, confidence, text_lang, declared, accepted.

    The text column is scored inside its own task; only hosts and sums are shuffled while the host
    priors fit a broadcast (`max_hosts`).
    """
    size = len(model.languages)
    if not size:
        none = F.lit(None).cast("string")
        return rows.withColumn(out, F.struct(
            none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"),
            F.lit(False).alias("accepted")))
    small_batches(rows.sparkSession)
    empty = F.lit("")
    evidence = F.struct(
        _code(declared if declared is not None else empty, model.languages).alias("declared"),
        _code(address if address is not None else empty, model.languages).alias("address"),
        F.coalesce(host if host is not None else empty, empty).alias("host"),
        _scorer(model)(F.coalesce(F.col(text_col), empty)).alias("judged"),
    )
    scored = rows.withColumn(out, evidence)
    thin = scored.select(f"{out}.*")
    shares = _posterior(F.col("judged.scores"), size)
    thin = thin.select("declared", "address", "host", *[s.alias(f"n{k}") for k, s in enumerate(shares)])
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(size)]
    # one pass over all texts gives the counts per host and declaration; the rest works on sums
    counted = thin.groupBy("host", "declared", "address").agg(*sums)
    counted = cut_lineage(counted)
    hosts = counted.groupBy("host").agg(*sums).withColumns({"domain": _domain(F.col("host")), "suffix": _suffix(F.col("host"))})
    priors = _smoothed(hosts, ("host", "domain", "suffix"), size)
    priors = priors.select(
        F.col("host").alias(f"__{out}_host"),
        F.array(*[F.col(f"n{k}") for k in range(size)]).alias(f"__{out}_n"),
        F.array(*[F.col(f"p{k}") for k in range(size)]).alias(f"__{out}_p"),
    )
    few = hosts.limit(max_hosts + 1).count() <= max_hosts
    joined = scored.join(
        F.broadcast(priors) if few else priors, F.col(f"{out}.host") == F.col(f"__{out}_host"), "left")
    tables = {c: _likelihoods(counted, c, model.languages) for c in ("declared", "address")}
    own = _posterior(F.col(f"{out}.judged.scores"), size)
    logs = []
    for k in range(size):
        left = [F.greatest(F.col(f"__{out}_n")[j] - own[j], F.lit(0.0)) for j in range(size)]
        mass = reduce(lambda a, b: a + b, left)
        prior = (left[k] + KAPPA * F.col(f"__{out}_p")[k]) / (mass + KAPPA)
        value = F.col(f"{out}.judged.scores")[k] + F.log(F.coalesce(prior, F.lit(1.0 / size)))
        for name, table in ((n, t) for n, t in tables.items() if t):
            value = value + reduce(
                lambda c, item: c.when(F.col(f"{out}.{name}") == item[0], F.lit(item[1][k])), table.items(), F  # noqa: B023
            ).otherwise(F.lit(0.0))
        logs.append(value)
    kept = joined.withColumn(out, F.struct(f"{out}.declared", f"{out}.judged.lettered", F.array(*logs).alias("logs"),
                                           F.col(f"{out}.judged.scores").alias("scores")))
    top = F.array_max(f"{out}.logs")
    mass = F.aggregate(f"{out}.logs", F.lit(0.0), lambda total, x: total + F.exp(x - top))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.element_at(names, F.array_position(f"{out}.logs", top).cast("int"))
    by_text = F.when(F.col(f"{out}.lettered"), F.element_at(
        names, F.array_position(f"{out}.scores", F.array_max(f"{out}.scores")).cast("int")))
    share = F.lit(1.0) / mass
    return kept.withColumn(out, F.struct(
        best.alias("lang"), share.alias("confidence"), by_text.alias("text_lang"), F.col(f"{out}.declared").alias("declared"),
        (F.col(f"{out}.lettered") & (share >= confidence)).alias("accepted"),
    )).drop(f"__{out}_host", f"__{out}_n", f"__{out}_p")


def _likelihoods(counted: DataFrame, column: str, languages: tuple[str, ...]) -> dict[str, list[float]]:
    """log P(value | language) of every declared value; at most as many values as languages."""
    size = len(languages)
    rows = counted.filter(F.col(column).isNotNull()).groupBy(column).agg(
        *[F.sum(f"n{k}").alias(f"n{k}") for k in range(size)]).collect()
    sums = {r[column]: [r[f"n{k}"] for k in range(size)] for r in rows}
    totals = [sum(v[k] for v in sums.values()) for k in range(size)]
    return {
        value: [log((n[k] + 1.0) / (totals[k] + size)) for k in range(size)] for value, n in sums.items()
    }
