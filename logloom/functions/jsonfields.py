"""Reading, canonicalising and editing the flat `fields` object of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import as_col, is_safe_key, let, trim_all

TEXT_MAP = "map<string,string>"
VALUE_MAP = "map<string,variant>"
STRING_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMERIC = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"

# fixed values: spellings of the host and trace keys
HOST_KEYS = ["host", "hostname"]
TRACE_KEYS = ["trace_id", "traceid", "trace-id"]


def field_text(fields_json: Column | str, key: str) -> Column:
    """Value of one key as text, '' where the key is missing or null."""
    return F.coalesce(F.get_json_object(as_col(fields_json), f"$['{key}']"), F.lit(""))


def numeric_text(value: Column) -> Column:
    """Finite double from numeric text, NULL for everything else."""
    text = trim_all(value)
    number = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def field_number(fields_json: Column | str, key: str) -> Column:
    return numeric_text(F.get_json_object(as_col(fields_json), f"$['{key}']"))


def text_map(fields_json: Column | str) -> Column:
    return F.from_json(as_col(fields_json), TEXT_MAP)


def loose_keys(fields: Column, strip: str) -> Column:
    """Sorted keys of a map as (plain, key): `plain` ignores case and separators."""
    keys = F.coalesce(F.array_sort(F.map_keys(fields)), F.array().cast("array<string>"))
    return F.transform(
        keys,
        lambda k: F.struct(F.translate(F.lower(trim_all(k)), strip, "").alias("plain"), k.alias("key")),
    )


def matching_keys(loose: Column, names: list[str], strip: str) -> Column:
    """Keys out of `loose_keys` that equal one of the names, smallest first."""
    wanted = sorted({"".join(c for c in n.lower() if c not in strip) for n in names})
    return F.transform(F.filter(loose, lambda e: e["plain"].isin(wanted)), lambda e: e["key"])


def loose_lookup(fields: Column, loose: Column, names: list[str], strip: str = "_-.") -> Column:
    """Trimmed value under the smallest matching key, '' if there is none."""
    key = F.get(matching_keys(loose, names, strip), F.lit(0))
    return F.coalesce(trim_all(F.try_element_at(fields, key)), F.lit(""))


def value_map(fields_json: Column | str) -> Column:
    """Map of typed JSON values, so a number and numeric text stay different."""
    return F.from_json(as_col(fields_json), VALUE_MAP)


def value_text(value: Column) -> Column:
    """Text of a typed value: strings without quotes, the rest as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def without_keys(fields: Column, dropped: Column) -> Column:
    return F.map_filter(fields, lambda k, _: ~F.array_contains(dropped, k))


def sorted_json(fields: Column) -> Column:
    """JSON text of a value map with sorted keys; `{}` when empty or missing."""

    def text(bound: Column) -> Column:
        parts = F.transform(
            F.array_sort(F.map_keys(bound)),
            lambda k: F.concat(json_string(k), F.lit(":"), F.to_json(F.element_at(bound, k))),
        )
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    return F.coalesce(let(fields, text), F.lit("{}"))


def json_string(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def has_object(value: Column) -> Column:
    """True where a JSON value is, or contains, an object."""

    def test(text: Column) -> Column:
        # only arrays and objects need the strings taken out before looking for a brace
        bare = F.regexp_replace(text, STRING_TOKEN, "")
        return text.rlike(r"\A[{\[]") & F.contains(bare, F.lit("{"))

    return let(F.to_json(value), test)


def trimmed_value_json(value: Column) -> Column:
    """JSON text of a value with all strings trimmed, also inside arrays of any depth.

    The string tokens of the JSON text are trimmed one by one; what stands between them stays.
    """

    def trimmed(token: Column) -> Column:
        return json_string(trim_all(F.try_variant_get(F.parse_json(token), "$", "string")))

    def rebuilt(text: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(text, F.lit(STRING_TOKEN), F.lit(0)), trimmed)
        between = F.split(text, STRING_TOKEN, -1)
        return F.array_join(F.zip_with(between, tokens, lambda gap, token: F.concat(gap, F.coalesce(token, F.lit("")))), "")

    def text_of(text: Column) -> Column:
        return F.when(text.rlike(r'\A["\[]') & F.contains(text, F.lit('"')), rebuilt(text)).otherwise(text)

    return F.coalesce(let(F.to_json(value), text_of), F.lit("null"))


def fields_error(fields: Column) -> Column:
    """First complaint about a value map, in key order; NULL if it is fine."""

    def complaint(bound: Column, key: Column) -> Column:
        name = trim_all(key)
        return (
            F.when(name == "", F.lit("fields keys must be non-empty"))
            .when(
                ~is_safe_key(name),
                F.concat(F.lit("fields key "), json_string(name), F.lit(" contains unsupported characters")),
            )
            .when(
                has_object(F.element_at(bound, key)),
                F.concat(
                    F.lit("fields["),
                    json_string(name),
                    F.lit("]: unsupported field value type object"),
                ),
            )
        )

    def first(bound: Column) -> Column:
        found = F.transform(F.array_sort(F.map_keys(bound)), lambda k: complaint(bound, k))
        return F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))

    return let(fields, first)


def canonical_fields(fields: Column) -> Column:
    """Canonical JSON text: trimmed keys and strings, sorted keys.

    Where two keys meet after trimming, the last one in original key order stays.
    """

    def text(bound: Column) -> Column:
        pairs = F.array_sort(
            F.transform(
                F.map_keys(bound), lambda k: F.struct(trim_all(k).alias("name"), k.alias("key"))
            )
        )

        def kept(sorted_pairs: Column) -> Column:
            last = F.filter(
                sorted_pairs,
                lambda p, i: ~F.coalesce(F.get(sorted_pairs, i + 1)["name"] == p["name"], F.lit(False)),
            )
            parts = F.transform(
                last,
                lambda p: F.concat(
                    json_string(p["name"]), F.lit(":"), trimmed_value_json(F.element_at(bound, p["key"]))
                ),
            )
            return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

        return let(pairs, kept)

    return F.coalesce(let(fields, text), F.lit("{}"))
