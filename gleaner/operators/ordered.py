"""Running values and short look-backs over ordered groups of any size.

A plain window sorts each group in one task, so a group with a third of all rows makes one
task do a third of the work. Rows are therefore range partitioned by (keys, order) into
blocks, whatever their number: a group may span many blocks, windows run inside (keys, block),
and each block is shifted by what came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleaner.session import sized, stored, stored_counted

BLOCK = "__block"
# A group with more rows is spread over blocks by the functions that count groups first.
LARGE = 1_000_000
# Groups are first counted by hash, in so many buckets.
BUCKETS = 1 << 16


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    descending: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums and last-non-null values per group, in `order`.

    `order` must be unique inside a group. `blocks` is the number of blocks; by default the
    session's shuffle setting decides.
    """
    sums, last = dict(sums or {}), dict(last or {})
    keys, order = list(keys), list(order)
    inputs = {f"__s_{n}": c for n, c in sums.items()} | {f"__l_{n}": c for n, c in last.items()}
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    rank = [F.col(k) for k in keys] + by
    ranged = df.withColumns(inputs)
    ranged = ranged.repartitionByRange(blocks, *rank) if blocks else ranged.repartitionByRange(*rank)
    # Partition number in the upper bits, row in the partition in the lower 33.
    place = F.monotonically_increasing_id()
    rows = stored(
        ranged.sortWithinPartitions(*rank)
        .withColumn("__place", place)
        .withColumns(
            {BLOCK: F.shiftright("__place", 33).cast("int"), "__head": F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) == 0}
        )
        .drop("__place"),
        "ordered",
    )

    # Blocks follow one another in (keys, order), so only the first group of a block can have
    # begun before it: what is carried over has at most one row per block, which bounds both
    # broadcasts below by the number of blocks.
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    same_keys = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    heads = rows.filter("__head").select(F.col(BLOCK).alias("__kb"), *named)
    spanning = rows
    if keys:
        spanning = rows.join(F.broadcast(heads.drop("__kb").distinct()), _all(same_keys), "left_semi")
    latest = F.min_by if descending else F.max_by
    totals = spanning.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums],
        *[
            latest(F.col(f"__l_{n}"), F.when(F.col(f"__l_{n}").isNotNull(), position(order))).alias(f"__f_{n}")
            for n in last
        ],
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *named,
        F.col(BLOCK).alias("__kb"),
        F.sum("__n").over(earlier).alias("__before"),
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__t_{n}") for n in sums],
        *[F.last(f"__f_{n}", ignorenulls=True).over(earlier).alias(f"__f_{n}") for n in last],
    ).filter(F.col("__before").isNotNull())

    inside = Window.partitionBy(*keys, BLOCK).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {f"__s_{n}": F.sum(f"__s_{n}").over(inside) for n in sums}
        | {f"__l_{n}": F.last(f"__l_{n}", ignorenulls=True).over(inside) for n in last}
    )
    joined = local.join(F.broadcast(carried), _all([F.col(BLOCK) == F.col("__kb"), *same_keys]), "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(f"__t_{n}").isNull(), F.col(f"__s_{n}"))
            .otherwise(F.coalesce(f"__s_{n}", F.lit(0)) + F.col(f"__t_{n}"))
            .alias(n)
            for n in sums
        ],
        *[F.coalesce(f"__l_{n}", f"__f_{n}").alias(n) for n in last],
    )


def position(order: Sequence[str]) -> Column:
    """The place of a row as one comparable value; a single column stays as it is, since
    aggregates over plain numbers need no sort."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", blocks: int | None = None
) -> DataFrame:
    """Number the rows of each group 1, 2, 3, ... in `order`."""
    return running(df, keys, order, sums={name: F.lit(1)}, blocks=blocks)


def by_size(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of groups of at most `limit` rows, laid by group over tasks of bounded size, and those of larger groups.

    Rows are counted by a hash of the group first, so what is shuffled for it does not grow with the groups. Only the
    groups of buckets of more than `limit` rows are counted one by one. Of the larger groups, fewer than rows / `limit`,
    only the keys are sent to all tasks. Either part is `None` if there is none of it.
    """
    keys, limit = list(keys), limit or LARGE
    rows = Observation()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n")).observe(rows, F.sum("__n").alias("n"))
    full, some = stored_counted(counts.where(F.col("__n") > limit).select("__b"), "full")
    total = rows.get["n"] or 0
    if not some:
        return sized(df, total, *keys), None
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    sizes = df.join(F.broadcast(full), bucket == F.col("__b"), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large, some = stored_counted(sizes.where(F.col("__n") > limit).select(*named), "large")
    if not some:
        return sized(df, total, *keys), None
    same = _all([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return sized(df.join(F.broadcast(large), same, "left_anti"), total, *keys), df.join(F.broadcast(large), same, "left_semi")


def running_by_size(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """`running` for frames of mostly small groups: those are one shuffle and no write, larger ones go the way of blocks."""
    sums, last = dict(sums or {}), dict(last or {})
    small, large = by_size(df, keys, limit)
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    made = {n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(inside) for n, c in last.items()}
    out = small.select("*", *[c.alias(n) for n, c in made.items()])
    return out if large is None else out.unionByName(running(large, keys, order, sums, last, descending))


def numbered_by_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", limit: int | None = None) -> DataFrame:
    """`numbered` for frames of mostly small groups."""
    return running_by_size(df, keys, order, sums={name: F.lit(1)}, limit=limit)


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    preceding: int,
    values: Callable[[Window], Mapping[str, Column]],
    size: int = 100_000,
    blocks: int | None = None,
) -> DataFrame:
    """Window expressions over the `preceding` rows before each row, in groups of any size.

    Groups are cut into stretches of `size` rows; the last `preceding` rows of a stretch are
    repeated at the head of the next, so every frame is complete inside its stretch.
    """
    if size < preceding:
        raise ValueError("size must be at least preceding")
    rows = numbered(df, keys, order, "__pos", blocks) if blocks or not keys else numbered_by_size(df, keys, order, "__pos")
    stretch = F.floor((F.col("__pos") - 1) / size)
    tail = (F.col("__pos") - 1) % size >= size - preceding
    placed = rows.withColumn(
        "__place",
        F.explode(
            F.when(
                tail,
                F.array(
                    F.struct(stretch.alias("s"), F.lit(False).alias("extra")),
                    F.struct((stretch + 1).alias("s"), F.lit(True).alias("extra")),
                ),
            ).otherwise(F.array(F.struct(stretch.alias("s"), F.lit(False).alias("extra"))))
        ),
    )
    frame = (
        Window.partitionBy(*keys, F.col("__place.s")).orderBy("__pos").rowsBetween(-preceding, -1)
    )
    made = values(frame)
    return (
        placed.withColumns(dict(made))
        .filter(~F.col("__place.extra"))
        .select(*df.columns, *made.keys())
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows of each group.

    The rank filter lets Spark cut every map task down to `n` rows per group before the
    shuffle, so a large group sends little.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def order_statistic(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], at: Callable[[Column], Column], name: str
) -> DataFrame:
    """One row per group: the value at 0-based position `at(n)` of its n sorted values."""
    ranked = numbered(df, keys, [value, *ties], "__pos")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    return (
        ranked.join(sizes, list(keys))
        .filter(F.col("__pos") - 1 == at(F.col("__size")))
        .select(*keys, F.col(value).alias(name))
    )


def as_of(
    rows: DataFrame, values: DataFrame, key: str, at: str, carry: Sequence[str], row_order: Sequence[str], value_order: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Each row with the latest value of its key at or before its time: a backward as-of join.

    Both sides are laid in one order, values before rows of the same time, and the last value is carried forward over
    blocks, so a key with a third of all rows is many tasks' work and nothing is matched pair by pair. A row before
    the first value of its key, or without a time, gets nulls. Of values of one time the last in `value_order` counts;
    `row_order` makes rows of one time distinct. A value without a time is never met.
    """
    other = F.struct(*[F.col(c) for c in rows.columns])
    mine = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), other.alias("__row"), F.to_json(F.struct(*row_order)).alias("__tie"))
    empty = F.lit(None).cast(mine.schema["__row"].dataType)
    last = F.struct(*[F.col(c) for c in carry])
    held = values.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(at).alias("__at")).agg(F.max_by(last, F.struct(*value_order)).alias("__value"))
    sides = held.select("__key", "__at", F.lit(0).alias("__side"), empty.alias("__row"), F.lit("").alias("__tie"), "__value").unionByName(
        mine.withColumn("__value", F.lit(None).cast(held.schema["__value"].dataType))
    )
    scan = {"last": {"__met": F.col("__value")}}
    order = ["__at", "__side", "__tie"]
    met = running(sides, ["__key"], order, blocks=blocks, **scan) if blocks else running_by_size(sides, ["__key"], order, **scan)
    return met.where("__side = 1").select("__row.*", *[F.col("__met")[c].alias(c) for c in carry])
