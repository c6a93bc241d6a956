"""Loops, emits, order and ids: from nested values to typed record rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import BLOCK
from gleaner.session import stored


def for_each(df: DataFrame, items: Column, name: str, at: str | None = None, sample: int | None = None) -> DataFrame:
    """One row per element, outer columns kept; null gives no rows.

    `at` keeps the 0-based position. `sample` is the top-level cap on a trial run: the array is
    cut before it is unnested, so the rest is never produced.
    """
    arr = items if sample is None else F.slice(items, 1, sample)
    # The outer form, then the filter: for the inner form Spark adds a test of the array's size
    # below it, which computes the array a second time.
    out = df.select("*", F.posexplode_outer(arr).alias(at or "__at", name)).filter(F.col(at or "__at").isNotNull())
    return out if at else out.drop("__at")


def for_each_variant(df: DataFrame, value: Column, name: str, at: str | None = None) -> DataFrame:
    """The same over VARIANT: an array gives its elements, null none, anything else itself."""
    kind = F.schema_of_variant(value)
    items = (
        F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>"))
        .when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        .otherwise(F.array(value))
    )
    return for_each(df, items, name, at)


def emit(df: DataFrame, type_name: str, bindings: Mapping[str, Column], order: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Project rows to records of one type.

    `order` is the place of the record in the run: capture, then loop positions, as longs. It
    doubles as a stable id that needs no shuffle; `with_record_ids` turns it into `rec-N`.
    """
    path = F.array(*[c.cast("long") for c in order])
    return df.select(
        F.concat(F.lit(type_name), F.lit("-"), F.array_join(path.cast("array<string>"), ".")).alias("_id"),
        F.lit(type_name).alias("_type"),
        path.alias("_order"),
        *[c.alias(n) for n, c in bindings.items()],
        *keep,
    )


def ref(type_name: str, order: Sequence[Column]) -> Column:
    """A reference to the record of `type_name` emitted at `order`; computed before children unnest."""
    path = F.array_join(F.array(*[c.cast("long") for c in order]).cast("array<string>"), ".")
    return F.struct(F.concat(F.lit(type_name), F.lit("-"), path).alias("_ref"), F.lit(type_name).alias("_type"))


def envelope(records: DataFrame) -> DataFrame:
    """Records of one type as `(_id, _type, _order, fields)` with fields as JSON, so types can be unioned."""
    hidden = {"_id", "_type", "_order"}
    return records.select(
        "_id",
        "_type",
        "_order",
        F.to_json(F.struct(*[c for c in records.columns if c not in hidden]), {"ignoreNullFields": "false"}).alias(
            "fields"
        ),
    )


def with_record_ids(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """Add `rec_id` = `rec-0, rec-1, ...` over the whole run in emission order.

    Rows are range partitioned by `_order`; only the number of rows of each block travels to
    the offsets, so no task sees the whole run.
    """
    ranged = records.repartitionByRange(blocks, "_order") if blocks else records.repartitionByRange("_order")
    # monotonically_increasing_id numbers rows inside a partition from 0 under the partition id.
    rows = stored(
        ranged.sortWithinPartitions("_order")
        .withColumn(BLOCK, F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ids",
    )
    from pyspark.sql import Window

    sizes = rows.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(BLOCK), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), BLOCK).select(
        *records.columns, F.concat(F.lit("rec-"), (F.col("__before") + F.col("__row"))).alias("rec_id")
    )


def prior_rows(records: DataFrame) -> DataFrame:
    """Records as the next stage sees them: `_id` and the fields."""
    return records.drop("_type", "_order")
