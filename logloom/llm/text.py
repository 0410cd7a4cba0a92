"""Column helpers shared by the training-data operators. All of them stay inside Spark SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# white space of the word contract: blank and the characters 9 to 13
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`; plain columns may be copied into every use."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words between the contract's white space, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: words without case and punctuation."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def mask_offsets(mask: str) -> list[int]:
    """Positions a mask such as `1101` looks at."""
    chosen = [i for i, c in enumerate(mask) if c == "1"]
    if not chosen or chosen[0] != 0 or mask[-1] != "1":
        raise ValueError(f"a mask starts and ends with 1: {mask!r}")
    return chosen


def masked_hash(array: Column, at: Column, mask: str, number: int = 0) -> Column:
    """Hash of the tokens a mask selects, from position `at` (0-based) on."""
    return F.xxhash64(F.lit(number), *[F.get(array, at + F.lit(i)) for i in mask_offsets(mask)])


def seeds(df: DataFrame, array: str, masks: Sequence[str], at: str, key: str) -> DataFrame:
    """One row per position and mask: `at` (0-based) and the masked hash `key`; rows too short give none.

    The columns of `df` stay, the token array too. Inside one code-generation stage they are
    references, so probing a broadcast table right after this copies no array per position.
    """
    short = min(map(len, masks))
    rows = df.filter(F.size(array) >= short).select(
        "*", F.explode(F.sequence(F.lit(0), F.size(array) - F.lit(short))).alias(at)
    )
    hashes = []
    for number, mask in enumerate(masks):
        value = masked_hash(F.col(array), F.col(at), mask, number)
        hashes.append(value if len(mask) == short else F.when(F.col(at) + F.lit(len(mask)) <= F.size(array), value))
    if len(hashes) == 1:
        return rows.withColumn(key, hashes[0])
    return rows.select("*", F.explode(F.array(*hashes)).alias(key))


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of id and text, never null: together the key of a row's content."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.lit(n), F.col(id_col), text).alias(f"k{n}") for n in (1, 2)]


ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most 1,000 rows at once: rows hold whole texts, and a worker keeps several
    copies of a batch. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
