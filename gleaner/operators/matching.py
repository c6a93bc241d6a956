"""Matching captures to URL rules, and requests to recorded exchanges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.iterate import for_each
from gleaner.operators.ordered import first_rows
from gleaner.session import sized


def _hits(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rules whose pattern is found in the URL, in rule order.

    Rules come with the job, a handful of constants, so each becomes one compiled expression
    of the scan and no join is needed.
    """
    return F.array_compact(
        F.array(
            *[
                F.when(F.rlike(url, F.lit(pattern)), F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("rule")))
                for i, (name, pattern) in enumerate(rules)
            ]
        )
    )


def match_rules(captures: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per match capture and matching rule; sort by (rule_no, seq) for the emission order.

    Captures that say what they are (`subkind`) count only if they are matched responses; documents have a rule of
    their own, `document_rule`.
    """
    return for_each(_matched(captures), _hits(F.col("url"), rules), "__hit").select(*captures.columns, "__hit.rule_no", "__hit.rule")


def unmatched_captures(captures: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return _matched(captures).filter(F.size(_hits(F.col("url"), rules)) == 0)


def _matched(captures: DataFrame) -> DataFrame:
    return captures.filter(F.col("subkind") == "match") if "subkind" in captures.columns else captures


def unfired_rules(captures: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules no capture matched: one pass that keeps one flag per rule."""
    fired = _matched(captures).agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.coalesce(F.bool_or(F.rlike("url", F.lit(pattern))), F.lit(False)).alias("fired"),
                )
                for name, pattern in rules
            ]
        ).alias("rules")
    )
    return fired.select(F.inline("rules")).filter(~F.col("fired")).select("rule")


def first_document(captures: DataFrame, run: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """The first document capture of each run."""
    docs = captures.filter((F.col("kind") == "browser") & (F.col("subkind") == "document"))
    if run:
        return first_rows(docs, run, [order])
    return docs.orderBy(order).limit(1)


def document_rule(
    captures: DataFrame, body: Callable[[DataFrame], DataFrame], run: Sequence[str] = (), order: str = "seq"
) -> DataFrame:
    """What the rule's body makes of the first document capture of each run; other documents are not evaluated."""
    return body(first_document(captures, run, order))


def url_key(url: Column) -> Column:
    """Path and sorted query: what two URLs must share, whatever their origin."""
    asked = F.contains(url, F.lit("?"))
    path = F.substring_index(url, "?", 1)
    query = F.substr(url, F.instr(url, F.lit("?")) + 1)
    rest = F.substring_index(path, "//", -1)
    below = F.when(F.contains(rest, F.lit("/")), F.substr(rest, F.instr(rest, F.lit("/")))).otherwise(rest)
    local = F.when(F.contains(path, F.lit("//")), below).otherwise(path)
    params = F.array_join(F.sort_array(F.split(query, "&", -1)), "&")
    return F.when(asked, F.concat(local, F.lit("?"), params)).otherwise(local)


def _recorded(captures: DataFrame, order: Sequence[str]) -> DataFrame:
    keyed = captures.withColumns({"__method": F.upper("method"), "__url": url_key(F.col("url"))})
    # Laid by key before they are sorted: bodies are wide, so a sort of whole file splits would spill.
    keyed = sized(keyed, captures.count(), "__method", "__url")
    kept = [c for c in ("url", "status", "response_headers", "body") if c in captures.columns]
    return first_rows(keyed, ["__method", "__url"], order).select(
        "__method", "__url", *[F.col(c).alias(f"hit_{c}") for c in kept]
    )


def replay(requests: DataFrame, captures: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Each request with the first recorded exchange of its method and URL key, headers too; misses have nulls.

    Exchanges are cut to one per key first, so a key recorded or asked for very often never
    multiplies rows; the split of a hot request key is left to AQE.
    """
    return requests.withColumns({"__method": F.upper("method"), "__url": url_key(F.col("url"))}).join(
        _recorded(captures, order), ["__method", "__url"], "left"
    ).drop("__method", "__url")


def replay_misses(requests: DataFrame, captures: DataFrame) -> DataFrame:
    known = captures.select(F.upper("method").alias("__method"), url_key(F.col("url")).alias("__url")).distinct()
    return (
        requests.withColumns({"__method": F.upper("method"), "__url": url_key(F.col("url"))})
        .join(known, ["__method", "__url"], "left_anti")
        .drop("__method", "__url")
    )


def accepted(status: Column) -> Column:
    """Whether a step goes on after this status."""
    return status.between(200, 399)


def endpoint_groups(captures: DataFrame) -> DataFrame:
    """Captures by kind, method and URL without query: how many, the first URL, first-seen place."""
    return captures.groupBy("kind", "method", F.split_part("url", F.lit("?"), F.lit(1)).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("url", "seq").alias("first_url"), F.min("seq").alias("first_seq")
    )


def extract_first(body: Column, pattern: str, names: Sequence[str]) -> dict[str, Column]:
    """Named groups of the first match; null where the body has no match."""
    from gleaner.functions.text import match

    captured = match(body, pattern)["captures"]
    return {n: F.get(captured, F.lit(i + 1)) for i, n in enumerate(names)}
