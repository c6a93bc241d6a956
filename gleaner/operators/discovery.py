"""Registry queries: inverse indexes, discovery, filters and pages.

An index is a table of `(term, member)` rows, not one list per term: a term most packages
share stays as many rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import numbered
from gleaner.operators.publishing import latest
from gleaner.session import stored

SORTS = ("created_at", "stars", "downloads")


def latest_index(versions: DataFrame, key: Sequence[str], term: str, version: str = "version") -> DataFrame:
    """`(term, key)` of the latest versions; `term` may be a value or an array."""
    rows = latest(versions, key, version)
    many = rows.schema[term].dataType.typeName() == "array"
    value = F.explode(term) if many else F.col(term)
    return rows.select(*key, value.alias(term)).filter(F.col(term).isNotNull()).distinct()


def discover(index: DataFrame, packages: DataFrame, versions: DataFrame, key: str, exact: Column | None = None) -> DataFrame:
    """Index members with the data of their package and latest version; members lacking either are left out.

    `exact` is a test of the latest version's own columns, such as which version of a type it pins: members that pin
    another are left out.
    """
    head = latest(versions, [key])
    head = head if exact is None else head.where(exact)
    return index.join(packages, key).join(head.select(key, "version", "recipe"), key)


def members_by_author(**kinds: DataFrame) -> DataFrame:
    """What each author has published, by kind: `(author, kind, member, total)`; each frame is `(author, member)`.

    Totals are counted before the join, so an author with very many members is one row of it.
    """
    out = None
    for kind, df in kinds.items():
        rows = df.select("author", F.lit(kind).alias("kind"), F.col("member").cast("string").alias("member")).distinct()
        out = rows if out is None else out.unionByName(rows)
    totals = out.groupBy("author", "kind").agg(F.count(F.lit(1)).alias("total"))
    return out.join(totals, ["author", "kind"])


def filter_packages(packages: DataFrame, category: str | None = None, query: str | None = None) -> DataFrame:
    """Category as given, and a substring of `author/slug description` in any case."""
    out = packages
    if category is not None:
        out = out.filter(F.col("category") == category)
    if query:
        shown = F.concat("author", F.lit("/"), "slug", F.lit(" "), F.coalesce("description", F.lit("")))
        out = out.filter(F.contains(F.lower(shown), F.lit(query.lower())))
    return out


def filter_signatures(signatures: DataFrame, output: Column, name: str | None = None) -> DataFrame:
    """Jobs that produce a type and have a substring in their name."""
    out = signatures.filter(F.array_contains("outputs", output))
    return out.filter(F.contains(F.lower("name"), F.lit(name.lower()))) if name else out


@dataclass(frozen=True)
class Pages:
    """`rows`: rows with their `page` (from 0), in files sorted by owner and order. `fences`: first and last order value
    of every page of an owner, and whether another follows."""

    rows: DataFrame
    fences: DataFrame
    owner: str
    order: str

    def page(self, owner, page: int) -> DataFrame:
        """One page of one owner. Owner and order values bound the read, so files and row groups beyond are skipped."""
        fence = self.fences.where((F.col("owner") == F.lit(owner)) & (F.col("page") == page)).select("first", "last").first()
        if fence is None:
            return self.rows.limit(0)
        return self.rows.where((F.col(self.owner) == F.lit(owner)) & F.col(self.order).between(fence["first"], fence["last"]))

    def after(self, owner, cursor) -> DataFrame:
        """The page that begins behind a cursor, the order value of a last row; an unknown cursor is a place like another."""
        begun = self.fences.where((F.col("owner") == F.lit(owner)) & (F.col("first") > F.lit(cursor))).agg(F.min("page")).first()[0]
        return self.rows.limit(0) if begun is None else self.page(owner, begun)


def paged(rows: DataFrame, owner: str, order: str, size: int) -> Pages:
    """Cut each owner's rows into pages in ascending `order`, which must be unique for an owner.

    One ordered scan numbers the rows; an owner with a third of all rows spans many blocks of it. The fences, one row
    for each page, come from partial aggregates.
    """
    placed = numbered(rows, [owner], [order], "_n").withColumn("page", F.floor((F.col("_n") - 1) / size)).drop("_n")
    table = stored(placed.repartitionByRange(owner, order).sortWithinPartitions(owner, order), "pages")
    ends = table.groupBy(F.col(owner).alias("owner"), "page").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    further = ends.select(F.col("owner").alias("_owner"), (F.col("page") - 1).alias("_page"))
    more = F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("page") == F.col("_page"))
    fences = stored(ends.join(further, more, "left").select("owner", "page", "first", "last", F.col("_page").isNotNull().alias("more")), "fences")
    return Pages(table, fences, owner, order)


def sort_packages(packages: DataFrame, by: str, ref: str) -> DataFrame:
    if by not in SORTS:
        raise ValueError(f"unknown sort {by}")
    return packages.orderBy(F.desc(by), F.asc(ref))


def keyset_page(rows: DataFrame, by: str, ref: str, cursor: tuple | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page in descending order of `by`, and the cursor of the next as zero or one row.

    The cursor is the `(by, ref)` of the last row seen, so the page is a filter and a top-n; no
    rows before it are sorted or skipped. An unknown cursor starts over.
    """
    ordered = rows
    if cursor is not None:
        value, last = cursor
        known = not rows.filter((F.col(by) == value) & (F.col(ref) == last)).isEmpty()
        if known:
            ordered = rows.filter((F.col(by) < value) | ((F.col(by) == value) & (F.col(ref) > last)))
    top = ordered.orderBy(F.desc(by), F.asc(ref)).limit(limit + 1)
    page = top.orderBy(F.desc(by), F.asc(ref)).limit(limit)
    # At most limit + 1 rows: the last of the page is the cursor if one more follows.
    seen = F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col(ref).alias("ref"))), _newest_first)
    cursor_row = top.agg(seen.alias("s")).filter(F.size("s") > limit).select(F.get("s", F.lit(limit - 1)).alias("c"))
    return page, cursor_row.select(F.col("c.by").alias(by), F.col("c.ref").alias(ref))


def _newest_first(a: Column, b: Column) -> Column:
    return (
        F.when(a["by"] > b["by"], -1)
        .when(a["by"] < b["by"], 1)
        .when(a["ref"] < b["ref"], -1)
        .when(a["ref"] > b["ref"], 1)
        .otherwise(0)
    )


def roles(pins: DataFrame, inputs: DataFrame, outputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pins with the part they play: `(…, role)` once for input and once for output. The pins are shuffled once."""
    played = inputs.select(*key, F.lit("input").alias("role")).unionByName(outputs.select(*key, F.lit("output").alias("role")))
    return pins.join(played.distinct(), list(key))


def pin_problems(declared: DataFrame, used: DataFrame, owner: str, name: str, version: str) -> DataFrame:
    """Used pins that are not declared, or declared at another version."""
    have = declared.select(
        F.col(owner).alias("__o"), F.col(name).alias("__n"), F.col(version).alias("declared_version")
    )
    joined = used.join(have, (F.col(owner) == F.col("__o")) & (F.col(name) == F.col("__n")), "left")
    return joined.filter(
        F.col("declared_version").isNull() | (F.col("declared_version") != F.col(version))
    ).select(
        owner, name, version, "declared_version",
        F.when(F.col("declared_version").isNull(), F.lit("not declared")).otherwise(F.lit("other version")).alias("problem"),
    )


def statuses(drafts: DataFrame, broken: DataFrame, deployed: DataFrame) -> DataFrame:
    """Drafts, broken drafts and deployments by name: `(name, draft, deployed_version)`.

    `drafts` and `deployed` have `name`; `broken` has the `path` it is known by. A name with
    both a draft and a broken file counts as broken.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    states = (
        drafts.select("name", F.lit(0).alias("bad"))
        .unionByName(broken.select(stem.alias("name"), F.lit(1).alias("bad")))
        .groupBy("name")
        .agg(F.max("bad").alias("bad"))
    )
    live = deployed.groupBy("name").agg(F.max("version").alias("deployed_version"))
    return states.join(live, "name", "full_outer").select(
        "name",
        F.when(F.col("bad") == 1, F.lit("broken")).when(F.col("bad") == 0, F.lit("valid")).otherwise(F.lit("missing")).alias("draft"),
        "deployed_version",
    )
