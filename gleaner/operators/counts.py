"""Record counts, expectations on them, and counts that run along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import first_rows, running

OPS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def count_by_type(records: DataFrame, type_col: str = "_type") -> DataFrame:
    return records.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))


def check_counts(records: DataFrame, expected: Sequence[tuple[str, str, int]], type_col: str = "_type") -> DataFrame:
    """One row per expectation `(type, op, n)` with the actual count and whether it is met.

    One pass with one counter per expectation; a type without records counts 0.
    """
    checks = [
        F.struct(
            F.lit(t).alias("type"),
            F.lit(op).alias("op"),
            F.lit(n).alias("expected"),
            F.count_if(F.col(type_col) == t).alias("actual"),
        )
        for t, op, n in expected
    ]
    return judged(records.agg(F.array(*checks).alias("c")).select(F.inline("c")))


def check_counts_by(records: DataFrame, run: str, expected: Sequence[tuple[str, str, int]], type_col: str = "_type") -> DataFrame:
    """`check_counts` for every run that has records: `(run, type, op, expected, actual, met)`, from one aggregate."""
    checks = [
        F.struct(F.lit(t).alias("type"), F.lit(op).alias("op"), F.lit(n).alias("expected"), F.count_if(F.col(type_col) == t).alias("actual"))
        for t, op, n in expected
    ]
    return judged(records.groupBy(run).agg(F.array(*checks).alias("c")).select(run, F.inline("c")))


def judged(rows: DataFrame) -> DataFrame:
    """Rows `(type, op, expected, actual)` with whether the expectation is met."""
    met = None
    for op, test in OPS.items():
        held = test(F.col("actual"), F.col("expected"))
        met = F.when(F.col("op") == op, held) if met is None else met.when(F.col("op") == op, held)
    return rows.withColumn("met", met)


def unmet(records: DataFrame, expected: Sequence[tuple[str, str, int]], type_col: str = "_type") -> DataFrame:
    return check_counts(records, expected, type_col).filter(~F.col("met"))


def running_total(records: DataFrame, type_col: str, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """The count of its type up to each record."""
    return running(records, [type_col], order, sums={"total": F.lit(1)}, blocks=blocks)


def group_records(records: DataFrame, type_col: str, order: str) -> DataFrame:
    """Types with their count and the place of their first record."""
    return records.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def first_per_type(records: DataFrame, type_col: str, order: Sequence[str], k: int = 3) -> DataFrame:
    """The first k records of each type, and how many more there are."""
    top = first_rows(records, [type_col], order, k)
    rest = records.groupBy(F.col(type_col).alias("__t")).agg(
        F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("remaining")
    )
    return top.join(rest, F.col(type_col).eqNullSafe(F.col("__t"))).drop("__t")


def progress(done: Column, baseline: Column) -> Column:
    """Percent of the baseline, at most 100; null without one."""
    return F.when(baseline > 0, F.least(F.lit(100.0), done / baseline * 100))
