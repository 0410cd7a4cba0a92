"""Best templates of many questions, against single pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import retrieval

VECTORS = "tenant_id bigint, template_id string, message_template string, model string, dims int, embedding array<float>"
QUESTIONS = "question_id bigint, tenant_id bigint, vector array<float>, question string"


def hard_tables(spark):
    rng = random.Random(4)
    words = ["disk", "full", "Slow", "<num>", "net", ""]

    def vector():
        return rng.choice([[rng.choice([-1.0, 0.0, 0.5, 2.0, math.nan if rng.random() < 0.02 else 1.0]) for _ in range(3)]] * 12
                          + [None, [], [1.0, None, 0.0], [1.0, 2.0], [0.0, 0.0, 0.0]])

    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", "c", "é", None]), rng.choice([None, *[" ".join(rng.sample(words, 3))] * 6]), "m", 3, vector())
            for _ in range(400)]
    asked = [(i % 50, rng.choice([1, 2, 3, None]), vector(), rng.choice([None, "", "disk", "FULL disk", "uuid"])) for i in range(60)]
    return spark.createDataFrame(rows + rows[:40], VECTORS), spark.createDataFrame(asked + asked[:3], QUESTIONS)


def plain(embeddings, questions, k):
    """Ranks and scores from the definition, one pair at a time."""
    rows = embeddings.alias("l").join(questions.alias("r"), "tenant_id")
    scored = rows.select("question_id", "template_id", retrieval.hybrid_score(
        retrieval.cosine(F.col("embedding"), F.col("vector")), retrieval.has_all_tokens(F.col("message_template"), F.col("question"))).alias("score"))
    found = {}
    for r in scored.collect():
        s = r.score
        place = (2, 0.0) if s is None else (0, 0.0) if math.isnan(s) else (1, -s)
        found.setdefault(r.question_id, []).append((place, (r.template_id is not None, (r.template_id or "").encode()), r))
    return {q: [(x[2].template_id, repr(x[2].score)) for x in sorted(v, key=lambda x: x[:2])[:k]] for q, v in found.items()}


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("k", [5, 100])
def test_many_questions_have_the_scores_of_single_pairs(spark, monkeypatch, few, k):
    embeddings, questions = hard_tables(spark)
    if not few:
        monkeypatch.setattr(retrieval, "fits", lambda *a, **b: False)
    ranked = []
    cut = retrieval.cut_lineage
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df: ranked.append(cut(df)) or ranked[-1])
    retrieval.hybrid_search_many(embeddings, questions, "m", 3, k)
    got = {}
    for r in ranked[0].orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.template_id, repr(r.score)))
    assert got == plain(embeddings, questions, k)


def test_questions_that_fit_make_no_rows_of_pairs(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    embeddings, questions = hard_tables(spark)
    # the plan of the ranking, before it is stored
    monkeypatch.setattr(retrieval, "cut_lineage", seen, raising=False)
    found = retrieval.hybrid_search_many(embeddings, questions, "m", 3, 5)
    [plan] = plans or [found._jdf.queryExecution().optimizedPlan().toString()]
    assert "Join" not in plan and plan.count("split(lower(message_template") == 1
