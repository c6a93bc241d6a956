"""Publishing: versions, forks, stars and the checks on a publish log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.graph import follow
from gleaner.operators.ordered import by_size, look_back, numbered_by_size, position, running

# A key with more publishes is not replayed in one row.
REPLAYED = 1000


def latest(versions: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key; of several with that version one.

    Every column is an aggregate of its own, so those that nobody reads are neither kept nor sorted.
    """
    whole = versions.schema[version].dataType.typeName() in ("byte", "short", "integer", "long")
    # A row without a version comes after all others.
    best = F.coalesce(F.col(version).cast("long"), F.lit(-(1 << 63))) if whole else F.struct(F.col(version).isNotNull(), F.col(version))
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(*[F.max_by(c, best).alias(c) for c in rest]).select(*versions.columns)


def next_version(publishes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the publishes of each key 1, 2, 3, ... as they came."""
    return numbered_by_size(publishes, key, order, "version")


def fresh_publishes(publishes: DataFrame, key: Sequence[str], order: Sequence[str], content: Column) -> DataFrame:
    """Publishes whose content differs from the one before; the others are no-ops.

    A no-op leaves the latest content as it was, so comparing neighbours is enough.
    """
    hashed = publishes.withColumn("content_hash", F.sha2(content.cast("string"), 256))
    paired = look_back(hashed, key, order, 1, lambda w: {"__prev": F.first("content_hash").over(w)})
    return paired.filter(~F.col("content_hash").eqNullSafe(F.col("__prev"))).drop("__prev")


def accepted_publishes(log: DataFrame, key: str, event: str, seq: str, base: str) -> DataFrame:
    """Publishes that were based on the latest version at the time, with the version they made.

    A key starts at version 0 and a publish is accepted when its base (null counts as 0) is
    the current version. So the accepted ones form a chain: the first with base 0, after it
    the first with base 1, and so on. A key of at most `REPLAYED` publishes is replayed in
    one row. For a longer one an ordered scan finds each publish's possible successor, and
    the chain is walked by doubling; no such key is replayed in one task.
    """
    few, many = by_size(log, [key], REPLAYED)
    steps = F.sort_array(F.collect_list(F.struct(F.col(seq), F.coalesce(base, F.lit(0)).alias("base"), F.col(event).alias("id"))))
    # The n-th accepted publish made version n, so the version reached is how many there are.
    none = F.array().cast(T.ArrayType(log.schema[event].dataType))
    made = F.aggregate(steps, none, lambda done, x: F.when(x["base"] == F.size(done), F.concat(done, F.array(x["id"]))).otherwise(done))
    replayed = few.groupBy(F.col(key).alias("__key")).agg(made.alias("__made"), F.collect_list(F.struct(*log.columns)).alias("__rows"))
    out = replayed.select("__made", F.explode("__rows").alias("__row")).select(F.array_position("__made", F.col(f"__row.{event}")).alias("made_version"), "__row.*")
    out = out.where("made_version > 0").select(event, *[c for c in log.columns if c != event], "made_version")
    return out if many is None else out.unionByName(_accepted_of_long(many, key, event, seq, base))


def _accepted_of_long(log: DataFrame, key: str, event: str, seq: str, base: str) -> DataFrame:
    rows = log.select(key, F.col(event).alias("id"), F.col(seq).alias("seq"), F.coalesce(base, F.lit(0)).alias("base"))
    asks = rows.select(key, "id", "seq", (F.col("base") + 1).alias("base"), F.lit(None).cast(log.schema[event].dataType).alias("hit"))
    offers = rows.select(key, "id", "seq", "base", F.col("id").alias("hit"))
    scan = running(asks.unionByName(offers), [key, "base"], ["seq"], last={"next": F.col("hit")}, descending=True)
    edges = scan.filter(F.col("hit").isNull()).select(F.col("id").alias("node"), "next")
    starts = (
        rows.filter(F.col("base") == 0)
        .groupBy(key)
        .agg(F.min_by("id", "seq").alias("node"))
        .select(F.col(key).alias("start"), "node")
    )
    walked = follow(edges, starts).select(F.col("node").alias(event), (F.col("hops") + 1).alias("made_version"))
    return log.join(walked, event)


def forks(packages: DataFrame, versions: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """Fork requests that succeed, as version 1 of a new package with its origin.

    `requests` is `(key, owner)`. A user who already has a package of that name, be it the one
    to fork, is refused; so is a fork of a package that does not exist.
    """
    head = latest(versions, [key]).select(key, F.col("version").alias("from_version"), "recipe")
    return (
        requests.distinct()
        .join(packages.select(key, owner), [key, owner], "left_anti")
        .join(packages.select(key), key, "left_semi")
        .join(head, key)
        .withColumn("version", F.lit(1))
    )


def star_state(events: DataFrame, user: str, package: str, order: Sequence[str], added: Column) -> DataFrame:
    """Who stars what: adds and removes are idempotent, so the last event of a pair decides."""
    state = events.groupBy(user, package).agg(
        F.max_by(added, position(order)).alias("__on"), F.max(position(order)).alias("__at")
    )
    when = [F.col("__at").alias(order[0])] if len(order) == 1 else [F.col(f"__at.{c}").alias(c) for c in order]
    return state.filter("__on").select(user, package, *when)


def star_counts(stars: DataFrame, package: str) -> DataFrame:
    return stars.groupBy(package).agg(F.count(F.lit(1)).alias("stars"))


def download_counts(downloads: DataFrame, forked: DataFrame, package: str) -> DataFrame:
    """Downloads per package; a fork counts as one."""
    return (
        downloads.select(package).unionByName(forked.select(package)).groupBy(package).agg(F.count(F.lit(1)).alias("downloads"))
    )


def profile_counts(
    packages: DataFrame, author: str, stars: DataFrame, user: str, known: DataFrame | None = None
) -> DataFrame:
    """Packages and stars per user: of everyone who has either, or is in `known(user)`."""
    have = packages.groupBy(F.col(author).cast("string").alias("user")).agg(F.count(F.lit(1)).alias("packages"))
    gave = stars.groupBy(F.col(user).cast("string").alias("user")).agg(F.count(F.lit(1)).alias("stars"))
    out = have.join(gave, "user", "full_outer")
    if known is not None:
        out = out.join(known.select(F.col("user").cast("string")).distinct(), "user", "full_outer")
    return out.select(
        "user", F.coalesce("packages", F.lit(0)).alias("packages"), F.coalesce("stars", F.lit(0)).alias("stars")
    )
