"""Trimming, canonical tags, safe character sets, levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character sets of tags and of keys / query filters
SAFE_TAG = r"\A[a-z0-9._:-]*\z"
SAFE_KEY = r"\A[A-Za-z0-9._:-]*\z"

# fixed values: accepted level spellings
LEVEL_SPELLINGS = {
    "info": ["info", "information", "informational"],
    "warn": ["warn", "warning"],
    "error": ["error", "err"],
    "debug": ["debug"],
    "trace": ["trace"],
    "fatal": ["fatal", "critical", "panic"],
}
# fixed values: levels counted as errors
ERROR_LEVELS = ["error", "fatal", "critical", "panic"]


# fixed values: Unicode white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once. Inside lambdas Spark does not share
    common sub-expressions, so an expensive one is bound to a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(value: Column | str) -> Column:
    """Strip every Unicode white space character, not only the blank."""
    return F.trim(as_col(value), F.lit(WHITE_SPACE))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(trim_all(value), F.lit(""))


def canon_tag(value: Column | str) -> Column:
    return F.lower(trim_all(value))


def is_safe_tag(value: Column | str) -> Column:
    return as_col(value).rlike(SAFE_TAG)


def is_safe_key(value: Column | str) -> Column:
    return as_col(value).rlike(SAFE_KEY)


def _level_choice(value: Column) -> Column:
    choice = None
    for level, spellings in LEVEL_SPELLINGS.items():
        test = value.isin(spellings)
        choice = F.when(test, level) if choice is None else choice.when(test, level)
    return choice


def ingest_level(value: Column | str) -> Column:
    """Canonical level, NULL where the spelling is not accepted."""
    return _level_choice(canon_tag(value))


def stored_level(value: Column | str) -> Column:
    """Canonical level; blank becomes info, unknown spellings are kept lower-case."""
    tag = F.coalesce(canon_tag(value), F.lit(""))
    return F.when(tag == "", "info").otherwise(F.coalesce(_level_choice(tag), tag))


def is_error(level: Column | str) -> Column:
    return canon_tag(level).isin(ERROR_LEVELS)


def contains_ignore_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def free_text(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring over the blank-joined columns."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))
