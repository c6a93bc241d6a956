"""String functions. A null head counts as the empty string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as Java's regex reads \s under (?U).
_SPACE = r"(?U)\s+"
_ENDS = r"(?U)^\s+|\s+$"


def as_text(c: Column) -> Column:
    """Text as it is, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def any_text(c: Column) -> Column:
    """A value of any type as text, null as ''. Doubles are printed in full; `typeof` is a constant, so other types
    pay nothing once the plan is optimised."""
    s = c.cast("string")
    return F.coalesce(F.when(F.typeof(c).isin("double", "float"), _printed(s)).otherwise(s), F.lit(""))


def double_text(c: Column) -> Column:
    """Print a double in full: no exponent, and no `.0` on whole numbers; null gives ''."""
    return F.coalesce(_printed(c.cast("string")), F.lit(""))


def _printed(s: Column) -> Column:
    """Of a double as Spark prints it."""
    return (
        F.when(s.endswith(".0"), F.left(s, F.length(s) - 2))
        .when(s == "Infinity", F.lit("inf"))
        .when(s == "-Infinity", F.lit("-inf"))
        .when(F.contains(s, F.lit("E")), _without_exponent(s))
        .otherwise(s)
    )


def _without_exponent(s: Column) -> Column:
    """`-1.25E3` as `-1250`: the digits moved past the point, or zeros put before them."""
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    exp = F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.rtrim(F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"[-.]", ""), F.lit("0"))
    size = F.length(digits)
    up = F.when(size <= exp + 1, F.rpad(digits, exp + 1, "0")).otherwise(
        F.concat(F.left(digits, exp + 1), F.lit("."), F.substr(digits, exp + 2))
    )
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    return F.concat(sign, F.when(exp >= 0, up).otherwise(down))


def lower(c: Column) -> Column:
    return F.lower(as_text(c))


def upper(c: Column) -> Column:
    return F.upper(as_text(c))


def trim(c: Column) -> Column:
    return F.regexp_replace(as_text(c), _ENDS, "")


def capitalize(c: Column) -> Column:
    s = as_text(c)
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def title_case(c: Column) -> Column:
    """First letter of each word upper, the rest lower; white space between words becomes one space."""
    return F.initcap(F.trim(F.regexp_replace(as_text(c), _SPACE, " ")))


def replace(c: Column, old: str, new: str) -> Column:
    s = as_text(c)
    if old:
        return F.replace(s, F.lit(old), F.lit(new))
    return F.concat(F.lit(new), F.array_join(F.transform(split(s, "", ends=False), lambda x: F.concat(x, F.lit(new))), ""))


def split(c: Column, sep: str, ends: bool = True) -> Column:
    """Literal split, empty pieces kept; an empty separator gives the characters between two ''."""
    s = as_text(c)
    if sep:
        return F.split(s, re.escape(sep), -1)
    chars = F.filter(F.split(s, "", -1), lambda x: x != "")
    return F.concat(F.array(F.lit("")), chars, F.array(F.lit(""))) if ends else chars


_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_BACK = re.compile(r"\\k<(\w+)>|\(\?P=(\w+)\)")
_OF_NAME = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")


def numbered_groups(pattern: str) -> tuple[str, list[str | None]]:
    """A pattern with its named groups as numbered ones, and the name of each group.

    Names may be written `(?<n>` or `(?P<n>`; Java takes the first only and no underscore, Python the second only.
    References by name become references by number.
    """
    out, names, at, in_class = [], [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if m := not in_class and _BACK.match(pattern, at):
            out.append(f"\\{names.index(m[1] or m[2]) + 1}(?:)")  # a digit after it is no part of the number
            at = m.end()
        elif c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
        elif in_class or c != "(":
            in_class = (c != "]") if in_class else c == "["
            if c == "[" and in_class and pattern[at + 1 : at + 2] in ("]", "^"):
                more = 2 if pattern[at + 1] == "^" and pattern[at + 2 : at + 3] == "]" else 1
                out.append(pattern[at : at + 1 + more])
                at += 1 + more
                continue
            out.append(c)
            at += 1
        elif m := _NAMED.match(pattern, at):
            names.append(m[1])
            out.append("(")
            at = m.end()
        else:
            if pattern[at + 1 : at + 2] != "?":
                names.append(None)
            out.append(c)
            at += 1
    return "".join(out), names


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(as_text(c), F.lit(numbered_groups(pattern)[0]))


def replace_all(c: Column, pattern: str, replacement: str) -> Column:
    """Replace every match; `$1`, `$name` and `${name}` stand for groups, an unknown name for nothing."""
    plain, names = numbered_groups(pattern)

    def number(m: re.Match) -> str:
        name = m[1] or m[2]
        return f"${names.index(name) + 1}" if name in names else ""

    return F.regexp_replace(as_text(c), plain, _OF_NAME.sub(number, replacement))


def match(c: Column, pattern: str) -> Column:
    """`{matched, captures}` of the first match; `captures[0]` is the whole match.

    A group that took no part is null. `regexp_extract` gives '' for it and for an empty
    group alike, so where both can happen a second pattern decides: a back reference holds
    only if the group took part, and the character next to the match is caught as proof.
    """
    s = as_text(c)
    pattern, names = numbered_groups(pattern)
    groups = len(names)
    skippable = re.search(r"\)[?*{]|\|", pattern) is not None
    on_empty = re.search(pattern, "")

    def group(i: int) -> Column:
        got = F.regexp_extract(s, pattern, i)
        if not skippable:
            return got
        proof = rf"(?:{pattern})(?:\{i}(?:(?=([\s\S]))|(?<=([\s\S])))|)"
        near = F.concat(F.regexp_extract(s, proof, groups + 1), F.regexp_extract(s, proof, groups + 2))
        took_part = F.when(s == "", F.lit(bool(on_empty and on_empty.group(i) is not None))).otherwise(near != "")
        return F.when((got != "") | took_part, got)

    hit = F.rlike(s, F.lit(pattern))
    found = F.array(F.regexp_extract(s, pattern, 0), *[group(i) for i in range(1, groups + 1)])
    none = F.array().cast("array<string>")
    return F.struct(hit.alias("matched"), F.when(hit, found).otherwise(none).alias("captures"))


def url_encode(c: Column) -> Column:
    """Form encoding that leaves `~` and escapes `*`."""
    return F.replace(F.replace(F.url_encode(as_text(c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
