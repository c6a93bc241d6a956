"""Paths, templates, cases and other functions over nested values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import any_text


def at(arr: Column, n: int) -> Column:
    """`[n]`: negative counts from the end; outside the array gives null."""
    return F.get(arr, F.lit(n)) if n >= 0 else F.try_element_at(arr, F.lit(n))


def at_strict(arr: Column, n: int | Column) -> Column:
    """`expr[n]`: outside the array, or no array at all, is an error."""
    n = F.lit(n) if isinstance(n, int) else n
    some = F.when(arr.isNull(), F.raise_error(F.lit("cannot index null"))).otherwise(arr)
    return F.element_at(some, F.when(n >= 0, n + 1).otherwise(n).cast("int"))


def each(arr: Column, name: str) -> Column:
    """`[*].name`: the field of every element."""
    return F.transform(arr, lambda x: x[name])


def wildcard(arr: Column) -> Column:
    """`[*]`: the array itself, null as the empty array."""
    return F.coalesce(arr, F.array())


def template(*parts: str | Column) -> Column:
    """Text and values in turn; null prints as ''."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else any_text(p) for p in parts])


def joined(arr: Column) -> Column:
    """An array inside a template: elements joined by ','; null elements as ''."""
    return F.array_join(arr.cast("array<string>"), ",", "")


def case_of(c: Column, labels: Mapping[str, Column], default: Column | None = None) -> Column:
    """Pick by the printed value of `c`; no label and no default is an error."""
    key = F.coalesce(c.cast("string"), F.lit("null"))
    out = None
    for label, value in labels.items():
        out = F.when(key == label, value) if out is None else out.when(key == label, value)
    missing = F.raise_error(F.concat(F.lit("no branch for "), key))
    return out.otherwise(missing if default is None else default)


def truthy_text(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def truthy_number(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def truthy_bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def truthy_array(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def length_of_text(c: Column) -> Column:
    return F.coalesce(F.char_length(c), F.lit(0))


def length_of_array(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))


def length_of_object(json: Column) -> Column:
    keys = F.json_object_keys(json)
    return F.when(keys.isNull(), F.lit(0)).otherwise(F.size(keys))


def dedup(arr: Column) -> Column:
    """Distinct elements, first occurrence kept in place; null is an error."""
    return F.when(arr.isNull(), F.raise_error(F.lit("dedup: expected array, got null"))).otherwise(
        F.array_distinct(arr)
    )


def first_of_array(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def first_of_text(c: Column) -> Column:
    return F.left(c, F.lit(1))


def coalesce(*cols: Column) -> Column:
    return F.coalesce(*cols)


def default(c: Column, value: Column) -> Column:
    return F.coalesce(c, value)


def get_field(json: Column, name: str) -> Column:
    """A key of a JSON object text as text; anything but an object gives null."""
    return F.try_variant_get(F.try_parse_json(json), f"$['{name}']", "string")


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, read as it stands: the session's zone plays no part."""
    days = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), c)
    return (
        days * 86_400_000_000
        + F.hour(c).cast("long") * 3_600_000_000
        + F.minute(c).cast("long") * 60_000_000
        + (seconds * 1_000_000).cast("long")
    )


def parse_json(text: Column, schema: str | None = None, strict: bool = True) -> Column:
    """JSON text to a typed value, or to VARIANT when the shape is unknown."""
    if schema is None:
        return F.parse_json(text) if strict else F.try_parse_json(text)
    return F.from_json(text, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
