"""Chat formatting with perspective rotation.

Every speaker of a conversation is the assistant once; in that rendering all others are named users,
system turns stay system turns, and only the assistant's own turns (with their end mark) are trained
on. The rendering of a perspective is a table of segments in order: joined they are the prompt text,
and start and end are each segment's place in it. Rows instead of one string per conversation keep
a conversation of any length spread over the cluster; `assemble` joins segments where the caller
knows that conversations are short.

Places come from two running sums, one inside blocks of turns and one over the blocks, so a
conversation that holds a third of all turns is not summed in one task.

Defined results: a null text renders as empty; a null role is the speaker `unknown`; rows with equal
(conv_id, turn) keep all their copies, ordered by role and text; a null conv_id is a conversation of
its own; conversations without a speaker (system turns only) give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
BLOCK = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with copies folded into a count, their block and the digest that orders equal turns."""
    rows = conversations.select(
        # a struct is never null and equals itself, so plain joins and windows share one exchange
        F.struct("conv_id").alias("conv"), F.col("turn"), F.coalesce(F.lower(F.trim("role")), F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("bigint"))


def segment(perspective: Column, speaker: Column, text: Column) -> Column:
    """One turn as text, seen by `perspective`."""
    header = (
        F.when(speaker == SYSTEM, F.lit("system\n"))
        .when(speaker == perspective, F.lit("assistant\n"))
        .otherwise(F.concat(F.lit("user name="), speaker, F.lit("\n")))
    )
    return F.concat(F.lit(START), header, text, F.lit(END))


def rotate(conversations: DataFrame) -> DataFrame:
    """Segments of every perspective: conv_id, perspective, turn, position, role, name, segment, start, end,
    train_start, train_end. The trained part of an assistant segment is its text and end mark."""
    turns = _turns(conversations)
    # speakers of a conversation; the join repeats turns once per speaker, not per pair of turns
    speakers = turns.filter(F.col("speaker") != SYSTEM).select(
        "conv", F.col("speaker").alias("perspective")).distinct()
    # dealt by block, whichever way Spark joins: after a join by conversation the windows would otherwise take its exchange
    seen = turns.join(speakers, "conv").repartition("conv", "perspective", "block")
    seen = seen.withColumn("segment", segment(F.col("perspective"), F.col("speaker"), F.col("text")))
    seen = seen.withColumn("length", F.length("segment").cast("bigint"))
    inside = Window.partitionBy("conv", "perspective", "block").orderBy("turn", "speaker", "text")
    placed = seen.withColumns({
        "end_in": F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "nth_in": F.row_number().over(inside),
    })
    sums = seen.groupBy("conv", "perspective", "block").agg(
        F.sum("length").alias("chars"), F.count("*").alias("turns"))
    over = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "conv", "perspective", "block",
        F.coalesce(F.sum("chars").over(over), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(over), F.lit(0)).alias("turns_before"),
    )
    full = placed.join(offsets, ["conv", "perspective", "block"])
    own = F.col("speaker") == F.col("perspective")
    end = F.col("chars_before") + F.col("end_in")
    tail = F.length("text") + F.lit(len(END))
    return full.select(
        "conv.conv_id", "perspective", "turn",
        (F.col("turns_before") + F.col("nth_in")).cast("bigint").alias("position"),
        F.when(F.col("speaker") == SYSTEM, "system").when(own, "assistant").otherwise("user").alias("role"),
        F.when((F.col("speaker") != SYSTEM) & ~own, F.col("speaker")).alias("name"),
        "segment",
        (end - F.col("length")).cast("bigint").alias("start"), end.cast("bigint").alias("end"),
        F.when(own, end - tail).cast("bigint").alias("train_start"), F.when(own, end).cast("bigint").alias("train_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One prompt and its trained spans per (conv_id, perspective); for conversations that fit into a row."""
    rows = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(
        F.struct("position", "segment", "train_start", "train_end"))).alias("rows"))
    return rows.select(
        "conv_id", "perspective", F.array_join(F.col("rows.segment"), "").alias("prompt"),
        F.transform(F.filter("rows", lambda r: r["train_start"].isNotNull()),
                    lambda r: F.struct(r["train_start"].alias("start"), r["train_end"].alias("end"))).alias("trained"),
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
      ELSE 'user name=' || speaker END || chr(10) || text || '<|im_end|>' || chr(10) AS segment
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(segment)) OVER w AS ends, row_number() OVER w AS position FROM seen
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, CAST(position AS BIGINT) AS position,
  CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name, segment,
  CAST(ends - length(segment) AS BIGINT) AS start, CAST(ends AS BIGINT) AS "end",
  CASE WHEN speaker = perspective THEN CAST(ends - length(text) - 11 AS BIGINT) END AS train_start,
  CASE WHEN speaker = perspective THEN CAST(ends AS BIGINT) END AS train_end
FROM placed
"""
