"""Snapshots and catalogs compared and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.ordered import first_rows, numbered
from gleaner.session import path_exists, sized


def snapshot_diff(before: DataFrame, after: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows that were added, removed, changed or left alone: the key, change, fields (that changed), copies.

    A key may repeat and be null. Equal rows of both sides are `unchanged`, as often as both have them. What is left
    of a key is paired in the order of its fields: a pair is `changed`, the rest `added` or `removed`. Both sides are
    reduced to counts of equal rows before they meet, so repeats are never multiplied.
    """
    key, fields = list(key), list(fields)
    both = before.select(*key, *fields, F.lit(1).alias("__b"), F.lit(0).alias("__a")).unionAll(
        after.select(*key, *fields, F.lit(0).alias("__b"), F.lit(1).alias("__a"))
    )
    counts = both.groupBy(*key, *fields).agg(F.sum("__b").alias("__b"), F.sum("__a").alias("__a"))
    alike = counts.where("__b > 0 AND __a > 0").groupBy(*key).agg(F.sum(F.least("__a", "__b")).alias("copies"))

    def rest(n: Column, name: str) -> DataFrame:
        """The copies that the other side lacks, numbered within their key by an ordered scan, so that no key is one task's."""
        own = counts.where(n > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("__a", "__b")
        placed = numbered(own, key, [*fields, "__copy"], f"__{name}")
        return placed.select(*[F.col(k).alias(f"__{name}_{k}") for k in key], f"__{name}", F.struct(*fields).alias(name))

    old = rest(F.col("__b") - F.col("__a"), "old")
    new = rest(F.col("__a") - F.col("__b"), "new")
    same = F.col("__old") == F.col("__new")
    for k in key:
        same = same & F.col(f"__old_{k}").eqNullSafe(F.col(f"__new_{k}"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("__old").isNull(), F.lit("added")).when(F.col("__new").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    moved = old.join(new, same, "full_outer").select(
        *[F.when(F.col("__old").isNull(), F.col(f"__new_{k}")).otherwise(F.col(f"__old_{k}")).alias(k) for k in key],
        change.alias("change"),
        F.when(F.col("__old").isNotNull() & F.col("__new").isNotNull(), F.array_join(differ, ",")).alias("fields"),
    )
    moved = moved.groupBy(*key, "change", "fields").agg(F.count(F.lit(1)).alias("copies"))
    return moved.unionByName(alike.select(*key, F.lit("unchanged").alias("change"), F.lit(None).cast("string").alias("fields"), "copies"))


def snapshot_mismatch(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either snapshot that the other lacks, duplicates counted; empty means equal.

    Order belongs to a snapshot, so compare frames that carry their order key. Both sides are
    reduced to counts of equal rows before one shuffle joins them.
    """
    cols = before.columns
    signed = before.select(*cols, F.lit(1).alias("__d")).unionByName(after.select(*cols, F.lit(-1).alias("__d")))
    return (
        signed.groupBy(*cols)
        .agg(F.sum("__d").alias("__d"))
        .filter(F.col("__d") != 0)
        .select(
            *cols,
            F.when(F.col("__d") > 0, F.lit("removed")).otherwise(F.lit("added")).alias("change"),
            F.abs("__d").alias("copies"),
        )
    )


def snapshot_equal(before: DataFrame, after: DataFrame) -> bool:
    return snapshot_mismatch(before, after).isEmpty()


def moves(prior: DataFrame, following: DataFrame, child: str, parent: str) -> DataFrame:
    """What an index of parents loses and gains when children move: child, parent, change.

    A child that keeps its parent gives no row, one that moved a `remove` from its old parent and an `add` to its
    new one; a null parent is none.
    """
    old = prior.select(F.col(child).alias("child"), F.col(parent).alias("__old"))
    new = following.select(F.col(child).alias("child"), F.col(parent).alias("__new"))
    moved = old.join(new, "child", "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    rows = F.array(F.struct(F.col("__old").alias("parent"), F.lit("remove").alias("change")), F.struct(F.col("__new").alias("parent"), F.lit("add").alias("change")))
    return moved.select("child", F.inline(rows)).where(F.col("parent").isNotNull())


def golden(spark: SparkSession, path: str, current: DataFrame, update: bool = False) -> tuple[str, DataFrame]:
    """Compare a snapshot with the golden one at `path`, which is written if there is none or `update` asks for it.

    Returns `written`, `equal` or `different`, and the rows that differ. The golden one changes in the first case only.
    """
    if update or not path_exists(spark, path):
        current.write.mode("overwrite").parquet(path)
        return "written", current.limit(0).withColumns({"change": F.lit(""), "copies": F.lit(0).cast("long")})
    found = snapshot_mismatch(spark.read.schema(current.schema).parquet(path), current)
    return ("equal" if found.isEmpty() else "different"), found


def set_changes(prior: DataFrame, following: DataFrame) -> DataFrame:
    """Rows to add to and remove from an index when `prior` becomes `following`."""
    cols = prior.columns
    return (
        following.select(*cols)
        .subtract(prior)
        .withColumn("change", F.lit("add"))
        .unionByName(prior.subtract(following.select(*cols)).withColumn("change", F.lit("remove")))
    )


def merge_catalog(shared: DataFrame, local: DataFrame, name: str) -> DataFrame:
    """Shared declarations, replaced by local ones of the same name; of several local ones the least row."""
    ranked = shared.withColumn("__rank", F.lit(1)).unionByName(local.withColumn("__rank", F.lit(0)))
    return first_rows(ranked, [name], ["__rank", *shared.columns]).drop("__rank")


def name_collisions(declared: DataFrame, name: str) -> DataFrame:
    """Names declared more than once, and how often."""
    return declared.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def column_union(objects: DataFrame, json: str) -> DataFrame:
    """Every key met in a column of JSON objects, with how many rows have it."""
    return (
        objects.select(F.explode(F.json_object_keys(json)).alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def change_log(rows: DataFrame, key: str, version: str, term: str) -> DataFrame:
    """What every version of an index adds and removes: `(key, version, term, change)`.

    `rows` are the terms of each version of a key, versions being consecutive. A term is added by a version whose
    predecessor lacks it and removed by one that lacks what its predecessor had; what the last version has stays.
    """
    terms = rows.select(key, version, term).where(F.col(term).isNotNull())
    # Each term stands at its version and at the next, so one grouping tells what either lacks. Nothing is broadcast:
    # a sorted index takes far less room on disk, by which Spark judges, than as rows.
    both = terms.withColumn("__now", F.lit(1)).unionByName(
        terms.where(F.col(version).isNotNull()).withColumns({version: F.col(version) + 1, "__now": F.lit(0)})
    )
    held = sized(both, 2 * rows.count(), key, version, term).groupBy(key, version, term).agg(F.max("__now").alias("__new"), F.min("__now").alias("__old"))
    added = held.where("__new = 1 AND __old = 1").select(key, version, term, F.lit("add").alias("change"))
    present = rows.select(key, version).distinct().select(F.col(key).alias("__k"), F.col(version).alias("__v")).hint("merge")
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col(version) == F.col("__v"))
    removed = held.where("__new = 0").select(key, version, term, F.lit("remove").alias("change")).join(present, same, "left_semi")
    return added.unionByName(removed)


def folded(log: DataFrame, key: str, version: str, term: str, upto: Column | None = None) -> DataFrame:
    """The index a change log leads to: `(key, term)` whose last change, of those where `upto` holds, is an add."""
    some = log if upto is None else log.where(upto)
    return some.groupBy(key, term).agg(F.max_by("change", version).alias("_last")).where("_last = 'add'").select(key, term)
