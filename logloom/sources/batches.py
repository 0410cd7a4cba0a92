"""Ingest batches: JSON text in, decoded batches with a decode error column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.jsonfields import json_string
from logloom.functions.text import let
from logloom.functions.timefns import as_datetime
from logloom.limits import DEFAULT, Limits, RequestError
from logloom.operators.binding import bind

# fixed values: keys of a batch and of a record
BATCH_TEXT = ["schema_version", "service", "env", "source"]
BATCH_KEYS = [*BATCH_TEXT, "logs"]
RECORD_TEXT = ["timestamp", "level", "message"]
RECORD_KEYS = [*RECORD_TEXT, "fields"]
TOO_LARGE = "request_body_too_large"
INVALID = "invalid_request_body"


def read_batches(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One JSON batch per line, or per file; the text is in `body`."""
    text = spark.read.text(path, wholetext=whole_files)
    return text.select(F.col("value").alias("body"))


_OBJECT = "map<string,variant>"


def _object(value: Column) -> Column:
    """Members of a JSON object, NULL for any other value."""
    return F.try_variant_get(value, "$", _OBJECT)


def _is_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _wrong_text(value: Column) -> Column:
    return ~_is_null(value) & (F.schema_of_variant(value) != "STRING")


def _unknown(members: Column, known: list[str]) -> Column:
    return F.size(F.array_except(F.map_keys(members), F.array(*[F.lit(k) for k in known]))) > 0


def _member(members: Column, name: str) -> Column:
    return F.try_element_at(members, F.lit(name))


def _text(members: Column, name: str) -> Column:
    return F.try_variant_get(_member(members, name), "$", "string")


def _decoded_record(record: Column) -> Column:
    """One record as a struct with a `bad` flag."""

    def decode(members: Column) -> Column:
        fields = _member(members, "fields")
        bad = members.isNull() | _unknown(members, RECORD_KEYS)
        for name in RECORD_TEXT:
            bad = bad | _wrong_text(_member(members, name))
        bad = bad | (~_is_null(fields) & _object(fields).isNull())
        return F.struct(
            *[_text(members, n).alias(n) for n in RECORD_TEXT],
            F.when(~_is_null(fields), _object(fields)).alias("fields"),
            F.coalesce(bad, F.lit(True)).alias("bad"),
        )

    return let(_object(record), decode)


def decode_batches(raw: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Add schema_version, service, env, source, logs and `decode_error`. The fields
    of a record are a map of typed values here; admission turns them into text.

    The body must be exactly one JSON object with known keys and the right types;
    anything else is an error, never an exception.
    """
    sized = raw.withColumn("body_bytes", F.octet_length("body").cast("bigint"))
    fits = F.col("body_bytes") <= limits.batch_bytes
    # wrapping shows text after the object and a second object alike
    wrapped = F.concat(F.lit('{"b":['), F.col("body"), F.lit('],"e":1}'))
    members = F.when(fits, F.try_variant_get(F.try_parse_json(wrapped), "$.b", "array<variant>"))
    one = let(members, lambda a: F.when(F.size(a) == 1, _object(F.get(a, F.lit(0)))))
    parsed = bind(sized, "_doc", one)
    doc = F.col("_doc")
    logs = _member(doc, "logs")
    items = F.try_variant_get(logs, "$", "array<variant>")
    parsed = bind(parsed, "_items", F.transform(items, _decoded_record))
    wrong = _unknown(doc, BATCH_KEYS) | (~_is_null(logs) & F.col("_items").isNull())
    for name in BATCH_TEXT:
        wrong = wrong | _wrong_text(_member(doc, name))
    bad_record = F.coalesce(F.exists("_items", lambda x: x["bad"]), F.lit(False))
    error = F.when(~fits, TOO_LARGE).when(doc.isNull() | wrong | bad_record, INVALID)
    decoded = bind(parsed, "decode_error", error)
    usable = F.col("decode_error").isNull()
    records = F.transform("_items", lambda x: F.struct(*[x[n].alias(n) for n in RECORD_KEYS]))
    return decoded.select(
        *[F.col(c) for c in raw.columns],
        *[F.when(usable, _text(doc, n)).alias(n) for n in BATCH_TEXT],
        F.when(usable, records).alias("logs"),
        "body_bytes",
        "decode_error",
    )


def message_id() -> Column:
    """Queue id of a raw event: its fingerprint, else its request id."""
    return F.coalesce(F.nullif("fingerprint", F.lit("")), F.col("request_id"))


def batch_json(service: Column, env: Column, source: Column, version: Column, records: Column) -> Column:
    """JSON text of a batch from its parts; `records` is an array of JSON texts."""
    return F.concat(
        F.lit('{"schema_version":'), json_string(version),
        F.lit(',"service":'), json_string(service),
        F.lit(',"env":'), json_string(env),
        F.lit(',"source":'), json_string(source),
        F.lit(',"logs":['), F.array_join(records, ","), F.lit("]}"),
    )


def replay(raw_events: DataFrame, mode: str, sequence: int | None = None, since=None) -> DataFrame:
    """Stored raw events to process again: all, from a sequence, or from a time.
    `live` is the checkpointed stream and needs no replay."""
    mode = (mode or "live").strip().lower()
    if mode in ("live", "all"):
        return raw_events
    if mode == "sequence":
        if not sequence or sequence <= 0:
            raise RequestError("replay mode sequence requires a positive sequence")
        return raw_events.filter(F.col("stream_seq") >= sequence)
    if mode == "time":
        try:
            start = as_datetime(since or "")
        except ValueError as error:
            raise RequestError("replay mode time requires an RFC3339 time") from error
        return raw_events.filter(F.col("stored_at") >= F.lit(start))
    raise RequestError(f"unsupported replay mode {mode!r}")
