"""op5 and op8 against plain Python, and their edge cases."""

import itertools
import random
import re

import pytest

from logloom.llm import decontaminate, licenses

SF = "/root/testdata/sf0.01"


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_CHARS, 0])
def test_planted_passages_are_found_and_clean_documents_are_not(spark, tables, limit):
    docs, benchmark = tables
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, benchmark, broadcast_chars=limit).collect()}
    rows = [(r.doc_id, " ".join(toks(r.text))) for r in docs.collect()]
    want = {(d, r.item_id) for r in benchmark.collect() for d, t in rows if " ".join(toks(r.text)[:15]) in t}
    assert found == want and want


def brute(doc, item, window, similarity, span):
    """Whether some ungapped placement has a window (or the whole overlap, if shorter) that is equal enough."""
    for shift in range(-len(item), len(doc)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        size = min(window, high - low)
        for start in range(low, high - size + 1):
            if size >= span and sum(item[i] == doc[i + shift] for i in range(start, start + size)) >= similarity * size:
                return True
    return False


def test_substitutions_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 50))] for _ in range(8)]
    docs = []
    for i in range(60):
        noise = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        part = list(rng.choice(items)) if i % 2 else []
        for k in rng.sample(range(len(part)), len(part) // 8):
            part[k] = "changed"
        at = rng.randrange(len(noise) + 1)
        docs.append(noise[:at] + part + noise[at:])
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(frame, bench).collect()}
    want = {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) if brute(d, t, 16, 0.8, 10)}
    assert found <= want
    assert len(found) >= 0.95 * len(want) and {i for i, _ in found} == {i for i in range(60) if i % 2}


def test_masks_hit_any_window_with_two_changed_tokens():
    """Every choice of changed tokens in a window of 16 that the similarity allows, against the placed masks."""
    placed = [{at + i for i, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for at in range(17 - len(m))]

    def share(changed):
        choices = list(itertools.combinations(range(16), changed))
        return sum(any(p.isdisjoint(c) for p in placed) for c in choices) / len(choices)

    assert share(1) == share(2) == 1.0
    assert 0.97 < share(3) < 0.98


def test_both_paths_return_the_same_rows(spark):
    rng = random.Random(5)
    item = [f"t{rng.randrange(12)}" for _ in range(40)]
    frame = spark.createDataFrame(
        [(1, " ".join(item)), (2, " ".join(item[5:30] * 2)), (2, " ".join(item[5:30] * 2)), (3, "a b c d e f g h i"), (4, "x y")],
        "doc_id bigint, text string")
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, "b c d e f"), (3, "x y"), (4, "a b")], "item_id bigint, text string")
    small = decontaminate.find_overlaps(frame, bench)
    large = decontaminate.find_overlaps(frame, bench, broadcast_chars=0)
    assert small.columns == large.columns
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert {(1, 1), (2, 1), (3, 2), (4, 3)} == {(r.doc_id, r.item_id) for r in small.collect()}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_CHARS, 0])
def test_short_items_against_brute_force(spark, limit):
    rng = random.Random(9)
    items = [[rng.choice("abc") for _ in range(rng.randrange(1, 10))] for _ in range(30)]
    docs = [[rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 60]))] for _ in range(60)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_hits, r.first_token, r.last_token, r.best_equal, r.best_length)
           for r in decontaminate.find_overlaps(frame, bench, broadcast_chars=limit).collect()}
    want = {}
    for i, d in enumerate(docs):
        for k, t in enumerate(items):
            at = [a for a in range(len(d) - len(t) + 1) if d[a:a + len(t)] == t]
            if at and (len(t) >= 5 or len(t) == len(d)):
                want[i, k] = (len(at), at[0], at[-1] + len(t), len(t), len(t))
    assert got == want and want


def test_decontamination_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, passage, "x"), (1, passage, "x"), (None, f"A {passage.upper()}!", "x"), (2, None, "x"), (3, "", "x"),
         (4, "p1 p2 p3", "x"), (5, ("long " * 50_000) + passage, "x"), (6, "clean words only here", "x")],
        "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(
        [(7, passage), (8, passage), (9, None), (10, ""), (None, passage), (11, "p1 p2")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert found == {(d, i) for d in (1, None, 5) for i in (7, 8)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontaminate.find_overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def shingles(text):
    t = toks(text)
    return {tuple(t[i:i + 3]) for i in range(len(t) - 2)}


def test_license_lines_of_the_table(spark, tables):
    docs = tables[0]
    found = {(r.doc_id, r.template) for r in licenses.scan_licenses(docs).collect()}
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-line", "Released under the MIT License.": "MIT-line",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-line",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0-line"}
    want = {(r.doc_id, name) for r in docs.collect() for line, name in lines.items() if line in r.text}
    assert found == want and want


def test_license_windows_against_brute_force(spark):
    rng = random.Random(5)
    names = sorted(licenses.TEMPLATES)
    docs = []
    for i in range(80):
        noise = [f"n{rng.randrange(500)}" for _ in range(rng.randrange(0, 120))]
        text = licenses.TEMPLATES[names[i % len(names)]].split() if i % 3 else []
        if text and i % 2 and len(text) > 25:
            text[rng.randrange(len(text))] = "other"
        at = rng.randrange(len(noise) + 1)
        docs.append(" ".join(noise[:at] + text + noise[at:]))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    found = {(r.doc_id, r.template) for r in licenses.scan_licenses(frame).collect()}
    whole = {(i, n) for i, d in enumerate(docs) for n in names if shingles(licenses.TEMPLATES[n]) <= shingles(d)}
    near = {(i, n) for i, d in enumerate(docs) for n in names
            if len(shingles(licenses.TEMPLATES[n]) & shingles(d)) >= 0.8 * len(shingles(licenses.TEMPLATES[n]))}
    assert whole <= found <= near and len(found) >= 0.98 * len(near)


def test_license_edge_cases(spark):
    line = licenses.TEMPLATES["MIT-line"]
    docs = spark.createDataFrame(
        [(1, line), (1, line), (None, "x " + line.upper()), (2, None), (3, ""), (4, "the mit"), (5, "w " * 60_000 + line)],
        "doc_id bigint, text string")
    got = {(r.doc_id, r.template, r.containment) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "MIT-line", 1.0), (None, "MIT-line", 1.0), (5, "MIT-line", 1.0)}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    own = spark.createDataFrame([("a", "alpha beta gamma delta"), ("b", None), (None, "x y z")], "template string, text string")
    text = spark.createDataFrame([(1, "so alpha beta gamma delta it")], "doc_id bigint, text string")
    assert [r.template for r in licenses.scan_licenses(text, own).collect()] == ["a"]
    assert licenses.scan_licenses(text, own.limit(0)).count() == 0


def test_band_settings_hold_their_promise():
    for similarity in (0.1, 0.3, 0.8):
        for rows in (1, 2):
            bands = licenses.bands_for(similarity, 1e-4, rows)
            assert (1 - similarity**rows) ** bands <= 1e-4 < (1 - similarity**rows) ** (bands - 1)


def test_plans_stay_native(spark, tables):
    docs, benchmark = tables
    for df in (decontaminate.find_overlaps(docs, benchmark), licenses.scan_licenses(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("Python", "Arrow", "CartesianProduct", "NestedLoop", "ExistingRDD"):
            assert bad not in plan


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_CHARS, 0])
def test_a_document_that_holds_a_whole_benchmark_many_times(spark, limit):
    """About 30,000 hits, with 12,000 tokens beside each: by size, not measured, over 5 GB of rows at once."""
    items = [[f"i{k}t{j}" for j in range(60)] for k in range(20)]
    text = " ".join(t for _ in range(10) for item in items for t in item)
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"x{i}" for i in range(100)))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.find_overlaps(docs, bench, broadcast_chars=limit)
    rows = {r.item_id: r for r in found.collect()}
    assert len(rows) == 20 and {r.doc_id for r in rows.values()} == {1}
    # all places of the shortest mask, ten times
    assert all(r.n_hits == 10 * 51 and r.best_equal == r.best_length == 16 for r in rows.values())
    assert all(r.first_token == 60 * k and r.last_token == 60 * (180 + k) + 60 for k, r in rows.items())


def test_no_whole_token_rows_are_handed_on_with_the_hits(spark, tables):
    """A lambda on the window is no part of generated code, and a condition with one moves down to the join of the items."""
    plan = decontaminate.find_overlaps(*tables)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert len(joins) == 2 and "lambdafunction" not in plan
    cut = next(line for line in plan.split("\n") if "Generate explode(array(struct(start" in line)
    assert cut.split("), [")[-1].startswith("doc_id") and "tokens" not in cut.split("), [")[-1]


@pytest.mark.parametrize("most", [decontaminate.FOUND_ROWS, 0])
def test_whole_documents_are_not_shuffled_to_drop_a_few(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "FOUND_ROWS", most)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, passage), (1, "other words"), (2, passage), (2, passage), (None, passage), (None, None), (3, None), (4, ""), (5, "kept " * 40), (5, "kept " * 40)],
        "doc_id bigint, text string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id bigint, text string"))
    rows = sorted((r.doc_id or 0, r.text or "") for r in left.collect())
    assert rows == [(0, ""), (1, "other words"), (3, ""), (4, ""), (5, "kept " * 40), (5, "kept " * 40)]
    joins = [line for line in left._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftAnti" in line]
    assert len(joins) == 1 and ("broadcast" in joins[0]) == (most > 0)
