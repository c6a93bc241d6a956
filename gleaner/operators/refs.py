"""References between records, and passing one stage's records to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import sized


def resolve(children: DataFrame, ref: str, parents: DataFrame, prefix: str = "parent_") -> DataFrame:
    """Children with the fields of the record their reference names; a dangling one has nulls."""
    target = parents.select(
        F.col("_id").alias("__id"),
        F.col("_type").alias("__ty"),
        *[F.col(c).alias(prefix + c) for c in parents.columns if not c.startswith("_")],
    )
    on = (F.col(f"{ref}._ref") == F.col("__id")) & (F.col(f"{ref}._type") == F.col("__ty"))
    return children.join(target, on, "left").drop("__id", "__ty")


def dangling(children: DataFrame, ref: str, parents: DataFrame, type_name: str, rows: int | None = None) -> DataFrame:
    """Children whose reference is null, of another type, or names no record.

    Given how many children there are at most (`rows`), both sides are laid by reference over tasks of bounded size,
    whatever the shuffle setting. The parents ask for it: an anti-join is moved below a layout of the children.
    """
    known = parents.filter(F.col("_type") == type_name).select(F.col("_id").alias("__id"))
    known = known if rows is None else sized(known, rows, "__id")
    wrong = F.coalesce(F.col(f"{ref}._type") != type_name, F.lit(True))
    key = F.when(~wrong, F.col(f"{ref}._ref"))
    return children.withColumn("__key", key).join(known, F.col("__key") == F.col("__id"), "left_anti").drop("__key")


def bind_single(df: DataFrame, prior: DataFrame, name: str) -> DataFrame:
    """The one record of the prior stage as a struct column: none gives null, several are an error.

    A scalar subquery: Spark computes it once and puts the value into the scan.
    """
    one = prior.select(F.struct(*prior.columns).alias(name)).scalar()
    return df.select("*", one.alias(name))

