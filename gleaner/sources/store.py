"""The record store: one Parquet table per record type, partitioned by run and attempt.

Rows are written under a fresh attempt, then the run's row in the commit table names it. Readers take the committed
attempt only: a run stays as it was while it is written again, and nothing of an earlier attempt is seen afterwards,
be it a type that is no longer emitted.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.iterate import envelope
from gleaner.session import path_exists, stored

RUN, ATTEMPT = "_scheduled_run_id", "_attempt"
HIDDEN = (RUN, ATTEMPT, "_emitted_at", "_order", "_type")
COMMITS = "_runs"


def write_records(frames: Mapping[str, DataFrame], base: str, run: Column | str, emitted_at: Column | int) -> None:
    """Write the records of one or many runs, then commit them.

    `frames` maps type to records with `_id` and `_order`; `run` is a constant or a column. Each frame is computed
    once: which runs to commit is read from the folders that were written. A table keeps its columns: records with
    others, or without some, are refused before anything is written. The rebalance hint evens out file sizes and
    splits a run that holds most of the rows.
    """
    one_run = run if isinstance(run, str) else None
    run = F.lit(run) if one_run is not None else run
    at = F.lit(emitted_at) if isinstance(emitted_at, int) else emitted_at
    spark = next(iter(frames.values())).sparkSession
    attempt = uuid.uuid4().hex
    ready = {}
    for name, records in frames.items():
        rows = records.withColumns({"_emitted_at": at.cast("long"), RUN: run.cast("string"), ATTEMPT: F.lit(attempt)})
        _check_columns(rows, f"{base}/{name}")
        ready[name] = rows
    runs = spark.range(1).select(F.lit(one_run).cast("string").alias(RUN)) if one_run is not None else None
    for name, rows in ready.items():
        rows.hint("rebalance", RUN).write.mode("append").partitionBy(RUN, ATTEMPT).parquet(f"{base}/{name}")
        if one_run is None:
            # Only folder names are read.
            mine = _rows(spark, f"{base}/{name}").where(F.col(ATTEMPT) == attempt).select(RUN).distinct()
            runs = mine if runs is None else runs.unionByName(mine)
    commits = runs.distinct().withColumn(ATTEMPT, F.lit(attempt))
    commits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(f"{base}/{COMMITS}")


def _check_columns(rows: DataFrame, path: str) -> None:
    """A table has one set of columns, so that no read drops any."""
    if not path_exists(rows.sparkSession, path):
        return
    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in (RUN, ATTEMPT)}
    have, come = kinds(_rows(rows.sparkSession, path)), kinds(rows)
    if have != come:
        odd = sorted({k for k in have.keys() | come.keys() if have.get(k) != come.get(k)})
        raise ValueError(f"columns of {path} differ: " + ", ".join(f"{k} {have.get(k, 'absent')} -> {come.get(k, 'absent')}" for k in odd))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    # Run ids stay text whatever they look like.
    text = {RUN, ATTEMPT}
    fields = [T.StructField(f.name, T.StringType()) if f.name in text else f for f in spark.read.parquet(path).schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _table(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    if not path_exists(spark, f"{base}/{name}") or not path_exists(spark, f"{base}/{COMMITS}"):
        return None
    commits = spark.read.schema(f"{ATTEMPT} string, {RUN} string").parquet(f"{base}/{COMMITS}")
    return _rows(spark, f"{base}/{name}").join(commits, [RUN, ATTEMPT], "left_semi")


def load_records(
    spark: SparkSession, base: str, name: str, run: str | None = None, limit: int | None = None, ordered: bool = True
) -> DataFrame | None:
    """Records of a type, one run or all, in emission order; `None` when the store has no such table.

    The run filter prunes partitions. `ordered=False` saves the sort where the order does not matter.
    """
    rows = _table(spark, base, name)
    if rows is None:
        return None
    if run is not None:
        rows = rows.filter(F.col(RUN) == run).drop(RUN)
    hidden = [c for c in HIDDEN if c in rows.columns and (run is not None or c != RUN)]
    if ordered or limit is not None:
        rows = rows.orderBy("_emitted_at", "_order")
    return (rows if limit is None else rows.limit(limit)).drop(*hidden)


def ephemeral(frames: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Records as temporary views instead of files: nothing outlives the session."""
    for name, records in frames.items():
        records.createOrReplaceTempView(f"{prefix}{name}")


def load_run_snapshot(spark: SparkSession, base: str, names: list[str], run: str | None = None) -> DataFrame:
    """The records of a run of all types as envelopes `(_id, _type, _order, fields)`."""
    out = None
    for name in names:
        rows = _table(spark, base, name)
        if rows is None:
            continue
        if run is not None:
            rows = rows.filter(F.col(RUN) == run)
        one = envelope(rows.drop("_emitted_at", RUN, ATTEMPT))
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_json(envelopes: DataFrame) -> DataFrame:
    """One JSON text per record: `{"_id", "typeName", "fields"}`."""
    head = F.to_json(F.struct("_id", F.col("_type").alias("typeName")))
    return envelopes.select(
        "_order", F.concat(F.regexp_replace(head, r"\}$", ',"fields":'), F.col("fields"), F.lit("}")).alias("record")
    )


def snapshot_by_type(envelopes: DataFrame, per_block: int = 1000) -> DataFrame:
    """Records by type in blocks of bounded size: `(_type, block, records, count)`.

    `count` is that of the whole type. A type of any size is written as many blocks, whose
    arrays in block order are the type's array. Types are few: what is broadcast is a row for each of
    them and task.
    """
    ranged = envelopes.select("_type", "_order", "fields").repartitionByRange("_type", "_order").sortWithinPartitions("_type", "_order")
    rows = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "by_type")
    # A row for each type and part: where the type begins in the part, and how many of it come before.
    parts = rows.groupBy(F.col("_type").alias("__t"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy("__t").orderBy("__p")
    starts = parts.select(
        "__t", "__p", "__first",
        F.coalesce(F.sum("__size").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy("__t")).alias("count"),
    )
    here = F.col("_type").eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p"))
    placed = rows.join(F.broadcast(starts), here).withColumn("__n", F.col("__at") - F.col("__first") + F.col("__before") + 1)
    placed = placed.withColumn("block", F.floor((F.col("__n") - 1) / per_block))
    return placed.groupBy("_type", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__n", "fields"))), lambda x: x["fields"]).alias("records"),
        F.first("count").alias("count"),
    )
