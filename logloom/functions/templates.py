"""Message templates: mask the variable parts, collapse white space, hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.hashing import short_sha
from logloom.functions.text import trim_all

# ASCII word boundaries; Java's \b is Unicode aware and would mask less.
_L, _R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# fixed values: masks, applied in this order
MASKS = [
    (r"(?i)" + _L + r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}" + _R, "<uuid>"),
    (_L + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _R, "<ip>"),
    (r"(?i)" + _L + r"(?:0x)?[0-9a-f]{12,}" + _R, "<hex>"),
    (_L + r"[0-9]+(?:\.[0-9]+)?" + _R, "<num>"),
]


def message_template(message: Column) -> Column:
    text = trim_all(message)
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return trim_all(F.regexp_replace(text, r"(?U)\s+", " "))


def template_id(template: Column) -> Column:
    return short_sha(template)
