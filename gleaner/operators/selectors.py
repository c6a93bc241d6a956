"""CSS selectors as column expressions over the element array of a page."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.operators.html import classes_of, node_attr

_PART = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[~|^$*]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]"
    r"|:(?P<pseudo>first-child|last-child|only-child|nth-child|first-of-type)(?:\((?P<arg>[^)]*)\))?"
)


def _compound(n: Column, text: str) -> Column:
    """One compound such as `div.ad[data-x="1"]:first-child` as a test of element `n`."""
    out, pos = F.lit(True), 0
    while pos < len(text):
        m = _PART.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"invalid selector {text!r}")
        out, pos = out & _test(n, m), m.end()
    return F.coalesce(out, F.lit(False))


def _test(n: Column, m: re.Match) -> Column:
    if m["tag"]:
        return F.lit(True) if m["tag"] == "*" else n["tag"] == m["tag"].lower()
    if m["id"]:
        return node_attr(n, "id") == m["id"]
    if m["cls"]:
        return F.array_contains(classes_of(n["attrs"]), m["cls"])
    if m["attr"]:
        return _attr_test(node_attr(n, m["attr"].lower()), m["op"], m["val"])
    return {
        "first-child": lambda: n["nth"] == 1,
        "last-child": lambda: n["nth"] == n["siblings"],
        "only-child": lambda: n["siblings"] == 1,
        "first-of-type": lambda: n["nth_of_type"] == 1,
        "nth-child": lambda: _nth(n["nth"], m["arg"] or ""),
    }[m["pseudo"]]()


def _attr_test(v: Column, op: str | None, val: str) -> Column:
    if op is None:
        return v.isNotNull()
    some = F.lit(val != "")
    return {
        "=": lambda: v == val,
        "^=": lambda: v.startswith(val) & some,
        "$=": lambda: v.endswith(val) & some,
        "*=": lambda: F.contains(v, F.lit(val)) & some,
        "~=": lambda: F.array_contains(F.split(v, r"\s+"), val) & some,
        "|=": lambda: (v == val) | v.startswith(val + "-"),
    }[op]()


def _nth(nth: Column, arg: str) -> Column:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip(), arg.replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or arg == "":
        raise ValueError(f"invalid :nth-child({arg})")
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    b = int(m[2] or 0)
    if a == 0:
        return nth == b
    return (F.pmod(nth - b, F.lit(abs(a))) == 0) & ((nth - b) * (1 if a > 0 else -1) >= 0)


def _steps(selector: str) -> list[tuple[str, str]]:
    """`a > b c` as [("", "a"), (">", "b"), (" ", "c")]."""
    tokens = re.findall(r"\s*[>+~]\s*|\s+|(?:\[(?:\"[^\"]*\"|'[^']*'|[^\]])*\]|\([^)]*\)|[^\s>+~\[(])+", selector.strip())
    if "".join(tokens) != selector.strip():
        raise ValueError(f"invalid selector {selector!r}")
    out, link = [], ""
    for tok in tokens:
        if tok.strip() in (">", "+", "~", ""):
            link = tok.strip() or " "
        else:
            out.append((link, tok))
            link = ""
    if not out or link:
        raise ValueError(f"invalid selector {selector!r}")
    return out


def _alternatives(selector: str) -> list[str]:
    """The parts between commas; a comma in brackets, parentheses or quotes separates nothing."""
    parts = re.findall(r"(?:\[(?:\"[^\"]*\"|'[^']*'|[^\]])*\]|\([^)]*\)|[^,\[(])+|,", selector)
    if "".join(parts) != selector:
        raise ValueError(f"invalid selector {selector!r}")
    out, last = [], ","
    for p in parts:
        if p == "," == last:
            raise ValueError(f"invalid selector {selector!r}")
        if p != ",":
            out.append(p)
        last = p
    if last == ",":
        raise ValueError(f"invalid selector {selector!r}")
    return out


def _bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row: a lambda variable is not evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def select(nodes: Column, selector: str, within: Column | None = None) -> Column:
    """The matching elements as an array in document order; a comma means either.

    `within` limits the search to one element and what is below it. The element itself can
    match, and nothing above it is seen.
    """
    chains = [_steps(one) for one in _alternatives(selector)]
    if within is None:
        return _select(nodes, chains, F.lit(0))
    part = F.slice(nodes, within["pre"] + 1, within["last"] - within["pre"] + 1)
    return _bind(part, lambda scope: _select(scope, chains, within["pre"]))


def _select(scope: Column, chains: list[list[tuple[str, str]]], base: Column) -> Column:
    if all(len(c) == 1 for c in chains):
        return F.filter(scope, lambda n: _any([_compound(n, c[0][1]) for c in chains]))

    def pick(found: list[Column], rest: list) -> Column:
        if not rest:
            return F.filter(scope, lambda n: _any([F.get(f, n["pre"] - base) for f in found]))
        return _walk(scope, rest[0], base, lambda flags: pick([*found, flags], rest[1:]))

    return pick([], chains)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _walk(scope: Column, steps: list[tuple[str, str]], base: Column, done) -> Column:
    """`done(flags)` with one flag per element: whether it ends a match of the chain."""

    def onward(flags: Column, rest: list) -> Column:
        if not rest:
            return done(flags)
        link, text = rest[0]
        if link in (" ", ">"):
            step = F.transform(scope, _inside(flags, link, text, base))
            return _bind(step, lambda f: onward(f, rest[1:]))
        marked = F.filter(scope, lambda s: F.get(flags, s["pre"] - base))
        return _bind(
            marked, lambda m: _bind(F.transform(scope, _beside(m, link, text)), lambda f: onward(f, rest[1:]))
        )

    return _bind(F.transform(scope, lambda n: _compound(n, steps[0][1])), lambda f: onward(f, steps[1:]))


def _inside(flags: Column, link: str, text: str, base: Column):
    def test(n: Column) -> Column:
        if link == " ":
            around = F.exists(n["ancestors"], lambda a: (a >= base) & F.get(flags, a - base))
        else:
            around = (n["parent"] >= base) & F.get(flags, n["parent"] - base)
        return _compound(n, text) & F.coalesce(around, F.lit(False))

    return test


def _beside(marked: Column, link: str, text: str):
    def test(n: Column) -> Column:
        near = (lambda s: s["nth"] == n["nth"] - 1) if link == "+" else (lambda s: s["nth"] < n["nth"])
        around = F.exists(marked, lambda s: (s["parent"] == n["parent"]) & near(s))
        return _compound(n, text) & F.coalesce(around, F.lit(False))

    return test
