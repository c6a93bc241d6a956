"""Functions by name, so a job can pipe a column through a chain and add its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from gleaner.functions import number, text, value

Transform = Callable[..., Column]

BUILT_IN: dict[str, Transform] = {
    "toString": text.any_text,
    "lower": text.lower,
    "lowercase": text.lower,
    "upper": text.upper,
    "uppercase": text.upper,
    "trim": text.trim,
    "capitalize": text.capitalize,
    "titleCase": text.title_case,
    "replace": text.replace,
    "split": text.split,
    "match": text.match,
    "matches": text.matches,
    "replaceAll": text.replace_all,
    "parseInt": number.parse_int,
    "parseFloat": number.parse_float,
    "parseBool": number.parse_bool,
    "length": value.length_of_text,
    "dedup": value.dedup,
    "first": value.first_of_array,
    "coalesce": value.coalesce,
    "default": value.default,
    "getField": value.get_field,
    "parseJson": value.parse_json,
}


def register(name: str, fn: Transform, base: dict[str, Transform] | None = None) -> dict[str, Transform]:
    """The table with one more function; a job's own function hides a built-in of the same name."""
    return {**(base or BUILT_IN), name: fn}


def _refuse(name: str, kind: str) -> Transform:
    def refuse(*_):
        raise TypeError(f"{name}: cannot take {kind}")

    return refuse


# What a function of many types does with one of them, by Spark's type name.
_WHOLE = dict.fromkeys(("tinyint", "smallint", "int", "bigint"))
BY_TYPE: dict[str, dict[str, Transform]] = {
    "parseInt": {"double": lambda c, *_: number.truncate_to_int(c), "float": lambda c, *_: number.truncate_to_int(c.cast("double"))}
    | {k: lambda c, *_: c.cast("long") for k in _WHOLE},
    "parseFloat": {k: lambda c, *_: c.cast("double") for k in ("double", "float", *_WHOLE)},
    "parseBool": {"boolean": lambda c, *_: c} | {k: lambda c, *_: c != 0 for k in _WHOLE},
    "length": {"array": value.length_of_array, "map": value.length_of_array},
    "first": {"string": value.first_of_text},
}
_TEXT_ONLY = ("lower", "lowercase", "upper", "uppercase", "trim", "capitalize", "titleCase", "replace", "split", "match", "matches", "replaceAll")
for _name in _TEXT_ONLY:
    BY_TYPE[_name] = {k: _refuse(_name, k) for k in ("array", "map", "struct")}


def pipe(
    head: Column, calls: Iterable[tuple], functions: dict[str, Transform] | None = None, on: DataFrame | None = None
) -> Column:
    """Send `head` through `(name, *args)` calls from left to right.

    With `on`, the frame that the column is of, each built-in call is chosen by the type it meets; the types are
    known when the plan is built, so nothing is decided by the row. Without it, text goes in.
    """
    table = functions or BUILT_IN
    for name, *args in calls:
        if name not in table:
            raise KeyError(f"unknown transform {name}")
        fn = table[name]
        if on is not None and fn is BUILT_IN.get(name) and name in BY_TYPE:
            kind = on.select(head.alias("v")).schema["v"].dataType.typeName()
            fn = BY_TYPE[name].get({"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}.get(kind, kind), fn)
        head = fn(head, *args)
    return head
