"""Template catalogue, embedding upkeep, hybrid search and incident evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.vectors import cosine, covers, has_all_tokens, hybrid_score, norm, tokens
from logloom.limits import DEFAULT, RequestError
from logloom.operators.search import newest_first, oldest_first
from logloom.operators.scoring import best_rows
from logloom.operators.skew import SALTS, fits, lookup_join, row_salt
from logloom.schemas import LOG_COLUMNS
from logloom.session import cut_lineage

EMBEDDING_KEY = ["tenant_id", "template_id", "model", "dims"]
NO_EVIDENCE = "No supporting incident logs were found."


def template_catalog(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct templates per tenant. Equal ids have equal text, so any value is the
    smallest one."""
    found = (
        logs.filter((F.col("template_id") != "") & (F.col("message_template") != ""))
        .groupBy("tenant_id", "template_id")
        .agg(F.min("message_template").alias("message_template"))
    )
    if limit is None:
        return found
    return found.orderBy("tenant_id", "template_id").limit(limit)


def templates_pending(
    catalog: DataFrame, embeddings: DataFrame, model: str, dims: int, limit: int | None = None
) -> DataFrame:
    """Catalogue rows without an embedding for this model and size."""
    done = embeddings.filter((F.col("model") == model) & (F.col("dims") == dims)).select(
        "tenant_id", "template_id"
    )
    pending = catalog.join(done, ["tenant_id", "template_id"], "left_anti")
    if limit is None:
        return pending
    return pending.orderBy("tenant_id", "template_id").limit(limit)


def embedding_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest row per (tenant, template, model, dims); vectors whose length is not
    `dims` are refused."""
    both = stored.unionByName(incoming).filter(F.size("embedding") == F.col("dims"))
    rest = [c for c in stored.columns if c not in EMBEDDING_KEY]
    newest = both.groupBy(*EMBEDDING_KEY).agg(
        F.max_by(F.struct(*rest), F.struct("updated_at", "message_template")).alias("_row")
    )
    return newest.select(*EMBEDDING_KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])


def embed(templates: DataFrame, embedder: Column, dims: int, model: str) -> DataFrame:
    """Embedding rows from any Column that maps message_template to a vector, such
    as a pandas UDF over a model. Vectors of another length are refused."""
    return templates.withColumn("embedding", embedder).filter(
        F.size("embedding") == dims
    ).select(
        "tenant_id", "template_id", "message_template", "embedding",
        F.lit(model).alias("model"), F.lit(dims).alias("dims"),
        F.current_timestamp().alias("updated_at"),
    )


def scored(
    embeddings: DataFrame, tenant_id: int, model: str, dims: int, vector: Column, question: Column
) -> DataFrame:
    """Every embedding of a tenant with similarity, keyword match and score."""
    if not tenant_id:
        raise RequestError("tenant id is required")
    rows = embeddings.filter(
        (F.col("tenant_id") == tenant_id) & (F.col("model") == model) & (F.col("dims") == dims)
    )
    marked = rows.withColumn("similarity", cosine(F.col("embedding"), vector)).withColumn(
        "keyword_match", has_all_tokens(F.col("message_template"), question)
    )
    return marked.withColumn("score", hybrid_score(F.col("similarity"), F.col("keyword_match")))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_topk(
    embeddings: DataFrame, tenant_id: int, model: str, dims: int, vector: list[float], k: int
) -> DataFrame:
    found = scored(embeddings, tenant_id, model, dims, literal_vector(vector), F.lit(""))
    return found.orderBy(F.desc("similarity"), "template_id").limit(k).select(
        "template_id", "message_template", "similarity"
    )


def hybrid_search(
    embeddings: DataFrame,
    tenant_id: int,
    model: str,
    dims: int,
    vector: list[float],
    question: str,
    k: int = DEFAULT.template_rows,
) -> DataFrame:
    """Best templates by 0.8 * cosine + 0.2 * keyword match; ties go to the smaller id."""
    if not question.strip():
        raise RequestError("question is required")
    found = scored(embeddings, tenant_id, model, dims, literal_vector(vector), F.lit(question.strip()))
    return found.orderBy(F.desc("score"), "template_id").limit(k).select(
        "template_id", "message_template", "score"
    )


def hybrid_search_many(
    embeddings: DataFrame, questions: DataFrame, model: str, dims: int, k: int = DEFAULT.template_rows
) -> DataFrame:
    """Best k templates for each row of questions(question_id, tenant_id, vector,
    question). Scores are cut to k inside content-based sub-groups first, so one
    tenant's templates are never ranked in one task.

    Pairs are what grows, so norms and words are taken once per row. Questions that may be broadcast are scored in
    Arrow batches, which hand on the best k only; more of them are paired in a join, with equal scores.
    """
    rows = embeddings.filter((F.col("model") == model) & (F.col("dims") == dims))
    ready = rows.select(
        "tenant_id", "template_id", "embedding", norm(F.col("embedding")).alias("_norm"),
        tokens(F.col("message_template")).alias("_words"),
    )
    asked = questions.select(
        "question_id", "tenant_id", "vector", norm(F.col("vector")).alias("_asked_norm"),
        tokens(F.col("question")).alias("_wanted"),
    )
    if fits(asked):
        slim = best_rows(ready, asked, k)
    else:
        pairs = lookup_join(ready, asked, ["tenant_id"])
        similarity = cosine(F.col("embedding"), F.col("vector"), F.col("_norm"), F.col("_asked_norm"))
        score = hybrid_score(similarity, covers(F.col("_words"), F.col("_wanted")))
        slim = pairs.select("question_id", "tenant_id", "template_id", score.alias("score"))
    # ids and scores only; a task keeps its best k per question before anything is shuffled
    order = [F.desc("score"), F.col("template_id")]
    salted = slim.withColumn("_salt", row_salt(slim, SALTS))
    local = Window.partitionBy("question_id", "tenant_id", "_salt").orderBy(*order)
    final = Window.partitionBy("question_id").orderBy(*order)
    best = (
        salted.withColumn("rank", F.row_number().over(local))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .drop("_salt")
    )
    best = cut_lineage(best)  # read three times below, and all pairs stand behind it
    # equal rows are winners of their own, but a template has one text
    key = ["tenant_id", "template_id"]
    won = lookup_join(rows.select(*key, "message_template"), best.select(*key).distinct(), key, how="left_semi")
    return best.join(won.dropDuplicates(key), key).select("question_id", "template_id", "message_template", "score", "rank")


def template_evidence(
    logs: DataFrame, tenant_id: int, matches: DataFrame, newest: int = 100, per_template: int = 3
) -> DataFrame:
    """At most `per_template` newest logs per matched template, taken out of the
    `newest` newest logs of all of them."""
    wanted = matches.select("template_id").distinct()
    hits = lookup_join(
        logs.filter(F.col("tenant_id") == tenant_id), wanted, ["template_id"], how="left_semi"
    )
    top = hits.orderBy(*newest_first(hits)).limit(newest)
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(*newest_first(hits)))
    return top.withColumn("rank", rank).filter(F.col("rank") <= per_template)


def newest_trace(logs: DataFrame, tenant_id: int, matches: DataFrame) -> DataFrame:
    """The trace with the newest log of any matched template (one row or none)."""
    wanted = matches.select("template_id").distinct()
    rows = logs.filter((F.col("tenant_id") == tenant_id) & (F.col("trace_id") != ""))
    return (
        lookup_join(rows, wanted, ["template_id"], how="left_semi")
        .groupBy("trace_id")
        .agg(F.max("timestamp").alias("newest"))
        .orderBy(F.desc("newest"), F.desc("trace_id"))
        .limit(1)
        .select("trace_id")
    )


def incident_trace(
    logs: DataFrame, tenant_id: int, matches: DataFrame, limit: int = DEFAULT.incident_rows
) -> DataFrame:
    """Logs of the newest trace with a matched template, oldest first. No time range:
    the evidence may lie any time before."""
    trace = newest_trace(logs, tenant_id, matches)
    rows = logs.filter(F.col("tenant_id") == tenant_id).join(
        F.broadcast(trace), "trace_id", "left_semi"  # one row by construction
    )
    extra = [c for c in ("event_id",) if c in logs.columns]
    shown = rows.select(*[c for c in LOG_COLUMNS if c in logs.columns], *extra)
    return shown.orderBy(*oldest_first(shown)).limit(limit)


def evidence_rows(trace_logs: DataFrame) -> DataFrame:
    """The part of each incident log that is handed on as evidence."""
    fields = F.coalesce(F.nullif("fields_json", F.lit("")), F.lit("{}")).alias("fields")
    ties = [c for c in ("event_id",) if c in trace_logs.columns]
    return trace_logs.select(
        "timestamp", "service", "level", "trace_id", "message", fields, *ties
    )


def evidence_document(trace_logs: DataFrame) -> DataFrame:
    """One JSON document of all given logs, oldest first; `incident_trace` bounds them."""
    rows = evidence_rows(trace_logs)
    item = F.struct("timestamp", "service", "level", "trace_id", "message", F.parse_json("fields").alias("fields"))
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("timestamp", F.to_json(item).alias("j")))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]"))
    return packed.select(
        F.size("items").alias("log_count"),
        body.alias("evidence"),
        F.when(F.size("items") == 0, NO_EVIDENCE).alias("answer"),
    )
