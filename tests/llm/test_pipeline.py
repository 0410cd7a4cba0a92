"""The pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from test_near_suffix import classes
from test_quality_secrets import base_spans

from logloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "secret_scan", "piece_encoding"]
    rows = {r.doc_id: r for r in docs.collect()}

    first = stages["language_id"](spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert kept >= {d for d, r in rows.items() if len(r.text) >= 100}

    second = stages["near_dedup"](spark, first, SF)
    assert second.columns == docs.columns
    want = set(classes([(d, rows[d].text) for d in sorted(kept)]).values())
    assert {r.doc_id for r in second.collect()} == want

    items = [r.text[20:80] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = stages["decontaminate"](spark, second, SF)
    assert {r.doc_id for r in third.collect()} == {d for d in want if not any(x in rows[d].text for x in items)}

    fourth = stages["secret_scan"](spark, third, SF)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    for r in fourth.collect():
        assert not base_spans(r.text)
        spans = base_spans(rows[r.doc_id].text)
        assert (r.text == rows[r.doc_id].text) == (not spans) and r.n_chars == len(r.text)

    fifth = stages["piece_encoding"](spark, fourth, SF).collect()
    assert len(fifth) == fourth.count() and all(r.lossless for r in fifth)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_pieces", "lossless"] and out.count() > 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    words = " ".join(["the and of that with this from was"] * 10)
    rows = [(1, words, "en", "s", 5, "x"), (1, words, "en", "s", 5, "x"), (None, None, None, None, None, "x"), (2, "", "en", "s", 0, None),
            (3, "der die und einer nicht mit " * 9 + " token = abcdefghijklmnop", "de", None, 9, "y")]
    rows += [(10 + i, f"the and of that with this from was number{i} " * (i + 2), "en", "s", 1, "z") for i in range(6)]
    rows += [(20 + i, f"der die und einer nicht mit zahl{i} " * (i + 2), "de", "s", 1, "z") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.count() > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert "[SECRET]" in texts[3] and None not in texts and 2 not in texts
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_all_operators_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
