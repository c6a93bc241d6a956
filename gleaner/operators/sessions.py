"""Event logs cut into runs, bursts and steps.

One log may hold most of all events. Each operator is one ordered scan, which carries the
last start, end or step along, and hash aggregates after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import position, running


def _named(pos: str, order: Sequence[str], prefix: str) -> list[Column]:
    if len(order) == 1:
        return [F.col(pos).alias(f"{prefix}_{order[0]}")]
    return [F.col(f"{pos}.{c}").alias(f"{prefix}_{c}") for c in order]


def session_runs(
    events: DataFrame,
    log: str,
    order: Sequence[str],
    start: Column,
    success: Column,
    failure: Column,
    emitted: Column,
    blocks: int | None = None,
) -> DataFrame:
    """Runs of each log: opened by a start, closed by the first success or failure after it.

    Records count while their run is open. The last run, if still open, was cancelled; an
    earlier one that never closed stays `running`.
    """
    pos = position(order)
    end = success | failure
    scan = running(
        events.withColumns({"__start": start, "__end": end, "__ok": success, "__emit": emitted}),
        [log],
        order,
        sums={"session": start.cast("int")},
        last={"__s": F.when(start, pos), "__e": F.when(end, pos)},
        blocks=blocks,
    ).filter(F.col("session") > 0)
    open_now = F.col("__e").isNull() | (F.col("__s") > F.col("__e"))
    runs = scan.groupBy(log, "session").agg(
        F.min(pos).alias("__from"),
        F.min(F.when(F.col("__end"), pos)).alias("__to"),
        F.min_by("__ok", F.when(F.col("__end"), pos)).alias("__won"),
        F.count_if(F.col("__emit") & open_now).alias("emitted"),
    )
    final = runs.groupBy(F.col(log).alias("__log")).agg(F.max("session").alias("__final"))
    cancelled = F.col("__to").isNull() & (F.col("session") == F.col("__final"))
    return runs.join(final, F.col(log).eqNullSafe(F.col("__log"))).select(
        log,
        "session",
        *_named("__from", order, "from"),
        *_named("__to", order, "to"),
        F.when(F.col("__won"), F.lit("ok"))
        .when(F.col("__to").isNotNull() | cancelled, F.lit("fail"))
        .otherwise(F.lit("running"))
        .alias("outcome"),
        F.when(cancelled, F.lit("cancelled")).alias("error"),
        "emitted",
    )


def emit_bursts(
    events: DataFrame, log: str, order: Sequence[str], emitted: Column, type_col: str, blocks: int | None = None
) -> DataFrame:
    """Stretches of emit events with no other event between: one row per burst and type."""
    scan = running(
        events.withColumn("__emit", emitted), [log], order, sums={"burst": (~emitted).cast("int")}, blocks=blocks
    )
    return (
        scan.filter("__emit")
        .groupBy(log, "burst", type_col)
        .agg(F.count(F.lit(1)).alias("n"), F.min(position(order)).alias("__first"))
        .select(log, "burst", type_col, "n", *_named("__first", order, "first"))
    )


def step_stats(
    events: DataFrame,
    run: str,
    order: Sequence[str],
    step: Column,
    sent: Column,
    received: Column,
    emitted: Column,
    succeeded: Column,
    failed: Column,
    at: Column,
    blocks: int | None = None,
) -> DataFrame:
    """Per run and step: requests, records, time from first request to last response, done, failed.

    Records and the end of the run are credited to the step of the last request before them.
    """
    pos = position(order)
    rows = running(
        events.withColumns(
            {
                "__step": step,
                "__sent": sent,
                "__received": received,
                "__emitted": emitted,
                "__end": succeeded | failed,
                "__failed": failed,
                "__at": at,
            }
        ),
        [run],
        order,
        last={"__current": F.when(sent, step)},
        blocks=blocks,
    )
    own = F.col("__sent") | F.col("__received")
    stats = (
        rows.withColumn("step", F.when(own, F.col("__step")).otherwise(F.col("__current")))
        .filter(F.col("step").isNotNull())
        .groupBy(run, "step")
        .agg(
            F.count_if("__sent").alias("requests"),
            F.count_if("__emitted").alias("emits"),
            F.min(F.when(F.col("__sent"), F.col("__at"))).alias("__t0"),
            F.max(F.when(F.col("__received"), F.col("__at"))).alias("__t1"),
            F.max(F.when(F.col("__sent"), pos)).alias("__last_sent"),
            F.max(F.when(F.col("__end"), pos)).alias("__last_end"),
            F.max(F.when(F.col("__failed"), pos)).alias("__last_fail"),
        )
        .filter(F.col("requests") > 0)
    )
    last_request = stats.groupBy(F.col(run).alias("__run")).agg(F.max("__last_sent").alias("__newest"))
    after = lambda p: F.coalesce(p > F.col("__last_sent"), F.lit(False))
    return stats.join(last_request, F.col(run).eqNullSafe(F.col("__run"))).select(
        run,
        "step",
        "requests",
        "emits",
        F.when(F.col("__t1") >= F.col("__t0"), F.col("__t1") - F.col("__t0")).alias("duration"),
        (after(F.col("__newest")) | after(F.col("__last_end"))).alias("done"),
        after(F.col("__last_fail")).alias("failed"),
    )
