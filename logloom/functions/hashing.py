"""Content hashes: 128 bits of SHA-256 as 32 hex characters, and numeric ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def stable_id(*parts: Column) -> Column:
    """Positive 60-bit id that depends only on the given parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def log_fingerprint(service, environment, source, level, message, fields_json) -> Column:
    return short_sha(
        F.concat_ws("\n", service, environment, source, level, message, fields_json)
    )
