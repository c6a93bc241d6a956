"""Health and trends over run history.

A run row is `(run_id, id, at, outcome, counts map<type, n>)`. A job may own most of the
history, so look-backs go through `ordered`; what is compared per run is at most seven maps
of declared types, inside one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import first_rows, look_back, order_statistic, running

# The drift rule.
DRIFT = 0.7
MIN_HISTORY = 3
PRIOR_RUNS = 7
RECENT = 30
WARN_BELOW = 0.95
WARN_DELTA = -5


def run_rows(records: DataFrame, keys: Sequence[str], type_col: str, at: str) -> DataFrame:
    """One row per run: `(*keys, counts, started, seconds)`, with `at` in microseconds.

    Records are counted by run and type first, so a run of any size meets the second
    aggregate as a handful of rows, one per declared type.
    """
    per_type = records.groupBy(*keys, type_col).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min(at).alias("__from"), F.max(at).alias("__to")
    )
    return per_type.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(type_col, "n"))).alias("counts"),
        F.min("__from").alias("started"),
        ((F.max("__to") - F.min("__from")) / 1_000_000).alias("seconds"),
    )


def prior_ok(runs: DataFrame, value: Column, name: str = "prior", blocks: int | None = None) -> DataFrame:
    """Add the values of up to seven most recent ok runs strictly before each run, oldest first."""
    ok = look_back(
        runs.filter(F.col("outcome") == "ok").withColumn("__v", value),
        ["run_id"],
        ["at", "id"],
        PRIOR_RUNS,
        lambda w: {name: F.collect_list("__v").over(w)},
        blocks=blocks,
    )
    upto = F.slice(F.concat(F.col(name), F.array("__v")), F.greatest(F.size(name) + 2 - PRIOR_RUNS, F.lit(1)), PRIOR_RUNS)
    rest = runs.filter(~F.col("outcome").eqNullSafe("ok"))
    both = ok.withColumn("__upto", upto).unionByName(rest, allowMissingColumns=True)
    filled = running(both, ["run_id"], ["at", "id"], last={"__before": F.col("__upto")}, blocks=blocks)
    none = F.array().cast(filled.schema["__before"].dataType)
    return filled.withColumn(
        name, F.when(F.col("outcome") == "ok", F.col(name)).otherwise(F.coalesce("__before", none))
    ).drop("__v", "__upto", "__before")


def median(values: Column) -> Column:
    """Middle of an array, the mean of the two middle values when even; 0 when empty."""
    s, n = F.sort_array(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((low.cast("double") + high) / 2)


def health(runs: DataFrame, enabled: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Add `health`: paused, fail, drift or ok.

    Only ok runs are judged against their past, so only they take part in the look-back.
    """
    judged = look_back(
        runs.filter(F.col("outcome") == "ok"),
        ["run_id"],
        ["at", "id"],
        PRIOR_RUNS,
        lambda w: {"__prior": F.collect_list("counts").over(w)},
        blocks=blocks,
    )
    types = F.array_distinct(F.flatten(F.transform("__prior", F.map_keys)))

    def of(counts: Column, t: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, t), F.lit(0))

    def drifted(t: Column) -> Column:
        mid = median(F.transform("__prior", lambda c: of(c, t)))
        return (mid > 0) & (of(F.col("counts"), t).cast("double") <= mid * DRIFT)

    drift = (F.size("__prior") >= MIN_HISTORY) & F.exists(types, drifted)
    ok = judged.withColumn("health", F.when(drift, F.lit("drift")).otherwise(F.lit("ok"))).drop("__prior")
    failed = runs.filter(~F.col("outcome").eqNullSafe("ok")).withColumn("health", F.lit("fail"))
    out = ok.unionByName(failed)
    if enabled is None:
        return out
    return out.withColumn("health", F.when(~enabled, F.lit("paused")).otherwise(F.col("health")))


def count_delta(runs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Per run and type: the count and its change from the run before; 0 if that had none of the type."""
    paired = look_back(
        runs, ["run_id"], ["at", "id"], 1, lambda w: {"__prev": F.first("counts").over(w)}, blocks=blocks
    )
    return paired.select("run_id", "id", "at", "__prev", F.explode("counts").alias("type", "n")).select(
        "run_id",
        "id",
        "at",
        "type",
        "n",
        F.coalesce(F.col("n") - F.try_element_at("__prev", F.col("type")), F.lit(0)).alias("delta"),
    )


def delta_class(n: Column, delta: Column) -> Column:
    return F.when(n == 0, F.lit("failing")).when(delta < WARN_DELTA, F.lit("warning")).otherwise(F.lit("good"))


def latest_run(runs: DataFrame) -> DataFrame:
    return first_rows(runs, ["run_id"], [F.desc("at"), F.desc("id")])


def count_series(runs: DataFrame) -> DataFrame:
    """Per type of the latest run, its count in every run, 0 where absent: rows `(run_id, type, at, id, n)`."""
    shown = latest_run(runs).select(F.col("run_id").alias("__job"), F.map_keys("counts").alias("__types"))
    return (
        runs.join(shown, F.col("run_id").eqNullSafe(F.col("__job")))
        .select("run_id", F.explode("__types").alias("type"), "at", "id", "counts")
        .select("run_id", "type", "at", "id", F.coalesce(F.try_element_at("counts", F.col("type")), F.lit(0)).alias("n"))
    )


def upper_medians(series: DataFrame) -> DataFrame:
    """Per series the upper of its middle values, and its length."""
    mid = order_statistic(series, ["run_id", "type"], "n", ["at", "id"], lambda n: F.floor(n / 2), "mid")
    sizes = series.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("points"))
    return mid.join(sizes, ["run_id", "type"])


def anomalies(series: DataFrame) -> DataFrame:
    """Points at or below 0.7 of the upper median, in series of three points or more."""
    return (
        series.join(upper_medians(series), ["run_id", "type"])
        .filter((F.col("points") >= MIN_HISTORY) & (F.col("mid") > 0))
        .filter(F.col("n") <= F.col("mid") * DRIFT)
        .drop("mid", "points")
    )


def trend(series: DataFrame) -> DataFrame:
    """Per type: failing at 0, warning below 0.95 of the upper median, else good."""
    last = series.groupBy("run_id", "type").agg(F.max_by("n", F.struct("at", "id")).alias("last"))
    tone = (
        F.when(F.col("last") == 0, F.lit("failing"))
        .when((F.col("mid") > 0) & (F.col("last") < F.col("mid") * WARN_BELOW), F.lit("warning"))
        .otherwise(F.lit("good"))
    )
    return last.join(upper_medians(series), ["run_id", "type"]).select("run_id", "type", "last", tone.alias("trend"))


def outcome_tally(runs: DataFrame, recent: int = RECENT) -> DataFrame:
    """Ok and failed runs among the most recent ones of each job."""
    return first_rows(runs, ["run_id"], [F.desc("at"), F.desc("id")], recent).groupBy("run_id").agg(
        F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "fail").alias("failed")
    )


def page_before(runs: DataFrame, before: Column, limit: int) -> DataFrame:
    """Newest runs before a time."""
    return runs.filter(F.col("at") < before).orderBy(F.desc("at"), F.desc("id")).limit(limit)
