"""Alert rules over event-time windows kept in streaming state.

`watch_stream` follows the stored logs: every file is read once, in the micro-batch that finds it. Matches of a
rule are kept in state until they fall out of the rule's window, which ends at the newest row the rule was ever
loaded for (matched or not), so what a micro-batch reads and holds follows the new rows and the open windows, not the
stored days.

State is keyed by (rule, shard). A match goes to the shard of its group and second, so a group with a
third of all matches is spread; the newest times go to all shards of their rule. Each shard hands over its counts
per (group, value), which are added up and measured like those of a batch evaluation.

A shard's rows lie in slots of the window, packed as Arrow bytes: a micro-batch makes one state call per slot
it touches, not one per match, and a slot that has left the window is dropped whole. Rows are kept per
(group, time, batch id, value) and replaced, not added, so a file written again by a repeated micro-batch counts once.

No timer is set: with processing time Spark goes on running empty micro-batches, so `availableNow` would never end. The rows
of a rule that was deleted stay, at most one window of them.

Rules are fixed while the query runs: stop and start it to change them. The state survives that; a rule whose
window has grown sees what was kept under the old one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.operators.lifecycle import reconcile
from logloom.operators.rules import compile_rules, measured, match_rules, runnable, triggered
from logloom.operators.skew import lookup_join
from logloom.schemas import LOGS
from logloom.session import cut_lineage

SHARDS = 16
SLOTS = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

ROW = ["group_key", "at", "ingest_id", "value"]
COUNTS = "rule_id bigint, group_key string, value double, n bigint, seen timestamp"


def pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows[[*ROW, "n"]], preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_pandas()


def slot_size(window: int) -> int:
    """Microseconds per slot: at most about SLOTS slots a window, whole seconds."""
    return max(1, -(-window // SLOTS)) * 1_000_000


class RuleWindow(StatefulProcessor):
    """The open window of one (rule, shard)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot bigint", "rows binary")
        self.reach = handle.getValueState("reach", "newest bigint, slot bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        window, seen = int(new["window_seconds"].max()), new["seen"].max()
        # a file read twice in one micro-batch, or a batch written twice, is the same row
        hits = new[new["group_key"].notna()].groupby(ROW, as_index=False, dropna=False)["n"].sum()
        if window > 0:
            hits = self._inside(hits, int(new["at"].max()), window)
        counts = hits.groupby(["group_key", "value"], as_index=False, dropna=False)["n"].sum()
        # the row without a group says that the rule was loaded
        marks = pd.DataFrame({"group_key": [None], "value": [None], "n": [0]})
        out = pd.concat([counts.astype({"group_key": object}), marks], ignore_index=True)
        yield pd.DataFrame({
            "rule_id": key[0], "group_key": out["group_key"], "value": [None if not v else float(v) for v in out["value"]],
            "n": out["n"].astype("int64"), "seen": seen})

    def _inside(self, hits: pd.DataFrame, newest: int, window: int) -> pd.DataFrame:
        """Rows of the window, the new ones among them; the state holds the same afterwards."""
        size = slot_size(window)
        if self.reach.exists():
            known = self.reach.get()
            newest, size = max(newest, known[0]), known[1]
        self.reach.update((newest, size))
        since = newest - window * 1_000_000
        fresh = {slot: part for slot, part in hits.groupby(hits["at"] // size) if (slot + 1) * size > since}
        found = []
        for (slot,), (data,) in list(self.slots.iterator()):
            if (slot + 1) * size <= since:
                self.slots.removeKey((slot,))
            else:
                old = unpack(data)
                if slot in fresh:
                    fresh[slot] = pd.concat([old, fresh[slot]], ignore_index=True).drop_duplicates(ROW, keep="last")
                else:
                    found.append(old)
        for slot, part in fresh.items():
            self.slots.updateValue((int(slot),), (pack(part),))
            found.append(part)
        rows = pd.concat(found, ignore_index=True) if found else hits[:0]
        return rows[rows["at"] >= since]

    def close(self) -> None:
        pass


def newest_per_scope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Newest times per (tenant_id, service, environment) of each Arrow batch; a stream has no plain aggregate."""
    for batch in batches:
        if batch.num_rows:
            table = pa.table(batch).group_by(["tenant_id", "service", "environment"]).aggregate([("at", "max"), ("seen", "max")])
            yield from table.select(["tenant_id", "service", "environment", "at_max", "seen_max"]).rename_columns(
                ["tenant_id", "service", "environment", "at", "seen"]).combine_chunks().to_batches()


def loaded(logs: DataFrame, rules: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Input of the state: matches, and the newest time of every rule that a row is in scope of, once per shard."""
    at = F.unix_micros("timestamp")
    matches = match_rules(logs, rules, sized_by=rules, carry=["ingest_id", "processed_at"])
    # a group's seconds lie in different shards, so a hot group is spread
    shard = F.pmod(F.xxhash64("group_key", F.date_trunc("second", "timestamp")), F.lit(shards)).cast("int")
    hits = matches.select(
        "rule_id", shard.alias("shard"), "window_seconds", "group_key", at.alias("at"), F.coalesce("ingest_id", F.lit("")).alias("ingest_id"),
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), F.lit(1).cast("bigint").alias("n"),
        F.col("processed_at").alias("seen"))
    scopes = logs.select(
        "tenant_id", "service", "environment", at.alias("at"), F.col("processed_at").alias("seen")).mapInArrow(
        newest_per_scope, "tenant_id bigint, service string, environment string, at bigint, seen timestamp")
    wanted = rules.select("rule_id", "tenant_id", "scope_service", "scope_environment", "window_seconds")
    here = F.col("r.scope_service").isNull() | (
        (F.col("l.service") == F.col("r.scope_service")) & (F.col("l.environment") == F.col("r.scope_environment")))
    none = F.lit(None).cast("string")
    marks = lookup_join(scopes, wanted, ["tenant_id"], here, sized_by=rules).select(
        "rule_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "window_seconds", none.alias("group_key"), "at",
        none.alias("ingest_id"), none.alias("value"), F.lit(0).cast("bigint").alias("n"), "seen")
    return hits.unionByName(marks)


def window_counts(logs: DataFrame, rules: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Stream of (rule_id, group_key, value, n, seen): the counts of the open windows of every rule that a
    micro-batch loads, in parts, and one row without a group per part."""
    return loaded(logs, rules, shards).groupBy("rule_id", "shard").transformWithStateInPandas(
        RuleWindow(), COUNTS, "Append", "None")


def window_triggers(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Triggers of one micro-batch of `window_counts`."""
    facts = rules.select("rule_id", "kind", "percentile")
    known = lookup_join(counts.filter("group_key IS NOT NULL").select("rule_id", "group_key", "value", "n"), facts, ["rule_id"], sized_by=rules)
    added = known.groupBy("rule_id", "group_key", "kind", "percentile", "value").agg(F.sum("n").alias("n"))
    return triggered(measured(added, ["group_key"], rules))


def logs_stream(spark: SparkSession, tables, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(f"{LOGS}, error_code string, event_date date, processed_at timestamp, _batch string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(tables.logs)


def watch_stream(
    spark: SparkSession, tables, rules: DataFrame, name: str = "watch", shards: int = SHARDS, max_files: int | None = None, **trigger
) -> StreamingQuery:
    """Follow the stored logs and move the alert state on by one step per micro-batch.

    Run it beside `process_stream` started without rules, since both would move the same alert state on. Steps are
    stored like those of `process_batch`: the same micro-batch again replaces its first try.
    """
    from logloom.streaming import pipeline

    compiled = cut_lineage(runnable(compile_rules(rules)))

    def store(batch: DataFrame, batch_id: int) -> None:
        session, key = batch.sparkSession, pipeline.batch_key(name, batch_id)
        batch.persist()
        try:
            ran = batch.groupBy("rule_id").agg(F.max("seen").alias("observed_at"))
            evaluated = compiled.join(ran, "rule_id")
            current, version = pipeline.alert_snapshot(session, tables, key)
            step = reconcile(window_triggers(batch, compiled), current, evaluated).persist()
            try:
                pipeline.store_step(step, compiled, rules, key, tables, version + 1)
            finally:
                step.unpersist()
        finally:
            batch.unpersist()

    counts = window_counts(logs_stream(spark, tables, max_files), compiled, shards)
    # state of a custom processor needs a provider with column families; the query keeps the setting it starts with
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        return (
            counts.writeStream.foreachBatch(store)
            .option("checkpointLocation", f"{tables.checkpoints}/{name}")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
