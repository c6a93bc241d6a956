"""Pagination as table analysis: which fetched pages a run would have kept.

A source may hold any share of all pages: running totals go through `ordered.running`, the
stop of a source is one aggregate row, and cursors are followed by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.graph import follow
from gleaner.operators.iterate import for_each
from gleaner.operators.ordered import running


def _until(pages: DataFrame, source: str, page: str, stop: Column) -> DataFrame:
    """Pages up to and including the first one where `stop` holds."""
    stops = pages.filter(stop).groupBy(F.col(source).alias("__src")).agg(F.min(page).alias("__stop"))
    return pages.join(stops, F.col(source).eqNullSafe(F.col("__src")), "left").filter(
        F.col("__stop").isNull() | (F.col(page) <= F.col("__stop"))
    ).drop("__src", "__stop")


def pages_with_total(
    pages: DataFrame, source: str, page: str, n_items: Column, total: Column, blocks: int | None = None
) -> DataFrame:
    """Keep pages until as many items as the page says in total came in, or a page is empty."""
    counted = running(
        pages.withColumns({"__n": F.coalesce(n_items, F.lit(0)), "__total": F.coalesce(total, F.lit(0))}),
        [source],
        [page],
        sums={"__seen": F.col("__n")},
        blocks=blocks,
    )
    stop = (F.col("__seen") >= F.col("__total")) | (F.col("__n") == 0)
    return _until(counted, source, page, stop).drop("__n", "__total", "__seen")


def pages_until_empty(pages: DataFrame, source: str, page: str, n_items: Column) -> DataFrame:
    """Keep pages up to the first one without items."""
    return _until(pages, source, page, F.coalesce(n_items, F.lit(0)) == 0)


def pages_by_cursor(pages: DataFrame, starts: DataFrame, source: str, token: str, next_token: Column) -> DataFrame:
    """Pages met by following `next_token` within a source from each `starts(source, token)`; rows get `hops`.

    Tokens mean something to their own source only: sources may use the same ones. A null or empty token ends the
    walk, and so does one that is not text.
    """
    kind = pages.select(next_token.alias("next")).schema["next"].dataType.simpleString()
    onward = F.when(next_token != "", next_token) if kind == "string" else F.lit(None).cast("string")
    place = lambda t: F.struct(F.col(source).alias("source"), t.alias("token"))
    edges = pages.select(place(F.col(token)).alias("node"), F.when(onward.isNotNull(), place(onward)).alias("next"))
    first = starts.select(place(F.col(token)).alias("node")).select(F.col("node").alias("start"), "node")
    met = follow(edges, first).select(F.col("node.source").alias("__src"), F.col("node.token").alias("__token"), "hops")
    same = F.col(source).eqNullSafe(F.col("__src")) & (F.col(token) == F.col("__token"))
    return pages.join(met, same).drop("__src", "__token")


def page_items(pages: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """Items of the kept pages with their place; order by (source, page, position)."""
    return for_each(pages, items, name, at="position")


# Fixed value: the requests that a run may make.
MAX_REQUESTS = 500


def request_cap(requests: DataFrame, run: str, order: list[str], cap: int = MAX_REQUESTS, strict: bool = False) -> DataFrame:
    """All requests, marked `over_cap` beyond the cap of their run, and `capped` if their run went beyond it.

    Nothing is dropped; `strict` raises at a request over the cap.
    """
    counted = running(requests, [run], order, sums={"__n": F.lit(1)})
    over = F.col("__n") > cap
    if strict:
        over = F.when(over, F.raise_error(F.lit(f"exceeded {cap} requests"))).otherwise(F.lit(False))
    sizes = requests.groupBy(F.col(run).alias("__run")).agg((F.count(F.lit(1)) > cap).alias("capped"))
    return counted.withColumn("over_cap", over).join(sizes, F.col(run).eqNullSafe(F.col("__run"))).drop("__run", "__n")


def capture_count_until(captures: DataFrame, run: str, order: list[str], needle: str, n: int) -> DataFrame:
    """Per run the capture at which the n-th URL containing `needle` arrived; runs that never got there are absent."""
    hits = captures.filter(F.contains("url", F.lit(needle)))
    reached = running(hits, [run], order, sums={"__n": F.lit(1)})
    return reached.filter(F.col("__n") == n).drop("__n")
