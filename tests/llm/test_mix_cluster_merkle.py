"""Source mixing, centroid clustering and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import clustering, merkle, mixing, queries
from logloom.llm.ranks import placed

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- places ---


def test_places_of_a_hot_group_with_equal_rows(spark):
    rows = [("hot", i % 50) for i in range(3000)] + [(None, 7), (None, None), ("a", 1)]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(7)
    out = placed(df, ["g"], [F.col("v")]).collect()
    by = defaultdict(list)
    for r in out:
        by[r.g].append(r)
    for group, found in by.items():
        found.sort(key=lambda r: r.place)
        assert [r.place for r in found] == list(range(len(found)))
        values = [(r.v is not None, r.v or 0) for r in found]
        assert values == sorted(values) and {r.width for r in found} == {len(found)}
    assert len(out) == len(rows)
    assert placed(df.limit(0), ["g"], [F.col("v")]).count() == 0


# --- Merkle manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves):
    """All levels of a tree, leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps_of(levels, place):
    for level in levels[:-1]:
        run, at = level[place // 16 * 16:place // 16 * 16 + 16], place % 16
        yield run[:at], run[at + 1:]
        place //= 16


def brute_manifest(rows):
    """(doc_id, leaf) with the other columns of the audit; rows are (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = h(*map(framed, (d, source, lang, n, text)))
        claimed = leaf
        if d is not None and zlib.crc32(str(d).encode()) % 5 == 0:
            lowered = text and re.sub("[A-Z]", lambda m: m[0].lower(), text)
            claimed = h(*map(framed, (d, source, lang, n, lowered)))
        trees[source].append((d is not None, d or 0, leaf, claimed, d))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for name in names:
        trees[name].sort(key=lambda r: r[:3])
        grown[name] = levels_of([r[2] for r in trees[name]])
    top = levels_of([grown[n][-1][0] for n in names]) if names else []
    out = []
    for number, name in enumerate(names):
        for place, (_, _, leaf, claimed, d) in enumerate(trees[name]):
            steps = [*steps_of(grown[name], place), *steps_of(top, number)]
            fold = claimed
            for left, right in steps:
                fold = h(*left, fold, *right)
            proof = h(*[x for left, right in steps for x in (*left, *right)])
            out.append((d, leaf, grown[name][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=str)


def audited(spark, rows, schema=DOCS):
    df = spark.createDataFrame(rows, schema)
    out = merkle.audit(merkle.document_manifest(df))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_manifest_against_plain_trees(spark):
    pick = random.Random(1)
    rows = [(i, f"Text {i} ÄB", "en", pick.choice(["hot"] * 6 + ["b", "é", "Z", None]), i) for i in range(700)]
    rows += [(1000 + i, f"one {i}", None, f"s{i}", None) for i in range(20)]
    pick.shuffle(rows)
    assert audited(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("count", [1, 2, 15, 16, 17, 256, 257])
def test_runs_of_every_shape(spark, count):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(count)]
    assert audited(spark, rows) == brute_manifest(rows)


def test_manifest_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "X", None, None, None), (5, "", "", "", 0), (5, "", "", "", 0),
            (5, "Other", "en", "", 1), (6, "A" * 300_000, "en", "a", 300_000), (7, None, "en", "a", 0)]
    more = [(*r, "x", "y", 3) for r in rows]
    assert audited(spark, more, DOCS + ", leaf string, place string, width bigint") == brute_manifest(rows)
    assert audited(spark, []) == []


def test_tampering_is_found_where_a_letter_changes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = {r.doc_id: r for r in merkle.audit(merkle.document_manifest(docs)).collect()}
    for d, r in rows.items():
        touched = zlib.crc32(str(d).encode()) % 5 == 0 and bool(re.search("[A-Z]", r.text or ""))
        assert found[d].verified != touched and (found[d].folded_root == found[d].root) != touched


# --- centroid clustering ---


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def assign():
        gaps = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(g.index(min(g)), min(g)) for g in gaps]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = sum(d for _, d in found)
    return sorted((i, c, d, sum(e for b, e in found if b == c), inertia,
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, found))


def clustered(spark, rows, schema="vec_id bigint, embedding array<float>"):
    out = clustering.summary(clustering.cluster(spark.createDataFrame(rows, schema)))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in out.collect())


def test_clusters_against_plain_rounds(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert clustered(spark, rows) == brute_clusters(rows)


def test_clusters_of_odd_vectors(spark):
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + pick.normal(scale=0.1, size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [float("nan")] + [1.0] * 63),
             (2005, [float("inf")] + [1.0] * 63), (2006, [None] + [1.0] * 63), (2007, [0.0] * 64), (2008, [0.0] * 64), (2009, [-0.001] * 64)]
    more = [(i, v, i, "x") for i, v in rows]
    assert clustered(spark, more, "vec_id bigint, embedding array<float>, cluster bigint, vector string") == brute_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(9)]
    assert clustered(spark, rows) == brute_clusters(rows)
    assert clustered(spark, []) == []


def test_bounds_hold_and_spare_comparisons():
    pick = np.random.default_rng(5)
    centres = pick.integers(-20_000, 20_000, size=(40, 64))
    rows = (centres[pick.integers(0, 40, 2000)] + pick.integers(-300, 300, size=(2000, 64))).astype(np.int64)
    rows[:50] = pick.integers(-(1 << 27), 1 << 27, size=(50, 64))
    simplex = clustering.simplex_of(np.vstack([centres[:1], centres[:1], (centres[:1] + centres[1:2]) // 2, centres]), 8)
    assert simplex.dims == 8
    tops, places = clustering.apexes(simplex, rows), clustering.apexes(simplex, centres)
    low, high = clustering.bounds(tops, places)
    exact = clustering.squares(rows, centres)
    slack = 1e-6 * ((tops ** 2).sum(axis=1)[:, None] + (places ** 2).sum(axis=1)[None, :] + 1)
    assert (low - slack <= exact).all() and (high + slack >= exact).all()
    best, distance, made = clustering.nearest(rows[50:], tops[50:], centres, places)
    assert (best == exact[50:].argmin(axis=1)).all() and (distance == exact[50:].min(axis=1)).all()
    assert made < 2 * len(best)


# --- source mixing ---


def brute_targets(sizes):
    """Targets per source: caps fixed one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def brute_tilt(sizes, target):
    """Bisection of the dual's gradient."""
    def words(t):
        return sum(n * min(3.0, math.exp(min(t * n, 5))) for n in sizes)

    if target >= 3 * sum(sizes) * (1 - 1e-12):
        return math.inf
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return low


def check_mix(rows, out, near=None):
    """`rows` are (doc_id, source, text)."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    totals = defaultdict(int)
    groups = defaultdict(list)
    for _, source, text in rows:
        totals[source] += size(text)
        groups[source].append(size(text))
    target = brute_targets(totals)
    assert sorted((str(r.doc_id), r.source or "", r.size) for r in out) == sorted((str(d), s or "", size(t)) for d, s, t in rows)
    tilt = {s: brute_tilt([n for n in groups[s] if n], target[s]) for s in groups if totals[s]}
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken == r.times * r.size <= 3 * r.size
        taken[r.source] += r.taken
        if r.size:
            rate = 3.0 if math.isinf(tilt[r.source]) else min(3.0, math.exp(min(tilt[r.source] * r.size, 5)))
            assert r.rate == pytest.approx(rate, rel=1e-5)
            assert abs(r.times - r.rate) < 1 + 1e-9
    for s, total in taken.items():
        bound = near if near is not None else max(groups[s]) / 2 + 1
        assert abs(total - target[s]) <= bound, (s, total, target[s])
    return taken, target


def test_mix_against_plain_duals(spark):
    pick = random.Random(2)
    rows = []
    for i in range(2400):
        source = pick.choice(["hot"] * 5 + ["a", "b", "c", "d", "é", None])
        rows.append((i, source, "w " * int(pick.lognormvariate(4, 1))))
    rows += [(9000 + i, "tiny", "w " * 10) for i in range(3)] + [(9100, "only", "w " * 500), (9200, "blank", ""), (9201, "blank", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = mixing.mix(df).collect()
    taken, target = check_mix(rows, out)
    for s in ("hot", "a", "b", "c", "d", "é", None):
        assert abs(taken[s] - target[s]) < 0.005 * target[s], s
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_of_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "a", "x y z")] * 400 + [(2, "a", "q"), (None, "a", "n n"), (None, None, "m m m"), (None, None, None), (3, "b", " \t\n")]
    rows += [(4, "b", "v " * 50_000)] + [(10 + i, "b", "t u") for i in range(50)]
    df = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id bigint, source string, text string, size bigint, target bigint")
    out = mixing.mix(df).collect()
    check_mix(rows, out)
    # copies of one row may differ, by one copy at most
    assert len({r.times for r in out if r.doc_id == 1}) <= 2


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, "", "en", "s", 0), (2, None, "en", None, 0)], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b c", "en", "s", 0)], DOCS)).collect()
    assert [(r.target, r.taken, r.times) for r in one] == [(3.0, 3, 1)]


def test_mix_query(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.QUERIES["op11_source_mix"](spark, SF)
    source = {d: s for d, s, _ in docs}
    found = [r for r in out.withColumn("source", F.create_map(*[F.lit(x) for d in docs for x in (d[0], d[1])])[F.col("doc_id")]).collect()]
    assert all(source[r.doc_id] == r.source for r in found)
    check_mix(docs, found)
