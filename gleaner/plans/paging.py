"""Pagination, sorting and pages of registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import discovery, paginate
from gleaner.operators.counts import first_per_type
from gleaner.operators.history import page_before as before
from gleaner.operators.ordered import numbered
from gleaner.operators.publishing import download_counts, latest, star_counts, star_state
from gleaner.plans import query
from gleaner.plans.tables import Tables

PER_PAGE = 3


def customer_pages(t: Tables) -> DataFrame:
    """A customer's orders in pages of three, then one empty page: `(source, page_no, body)`."""

    def make():
        rows = numbered(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "n")
        sizes = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
        full = rows.groupBy("o_custkey", F.ceil(F.col("n") / PER_PAGE).alias("page_no")).agg(
            F.sort_array(F.collect_list("o_orderkey")).alias("list")
        )
        empty = sizes.select(
            "o_custkey",
            (F.ceil(F.col("total") / PER_PAGE) + 1).alias("page_no"),
            F.array().cast("array<bigint>").alias("list"),
        )
        pages = full.unionByName(empty).join(sizes, "o_custkey")
        return pages.select(
            F.col("o_custkey").alias("source"), "page_no", F.to_json(F.struct("list", "total")).alias("body")
        )

    return t._once("customer_pages", make)


def _read(t: Tables) -> DataFrame:
    return customer_pages(t).withColumn("doc", F.from_json("body", "list array<long>, total long"))


PAGES_SQL = """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
      count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)"""


@query("pages_with_total", f"{PAGES_SQL} SELECT o_custkey AS source, ceil(i / 3.0)::BIGINT AS page_no, count(*) AS n FROM n GROUP BY 1, 2")
def pages_with_total(t):
    kept = paginate.pages_with_total(_read(t), "source", "page_no", F.size("doc.list"), F.col("doc.total"))
    return kept.select("source", "page_no", F.size("doc.list").cast("long").alias("n"))


@query(
    "pages_until_empty",
    f"""{PAGES_SQL} SELECT o_custkey AS source, ceil(i / 3.0)::BIGINT AS page_no FROM n GROUP BY 1, 2
    UNION ALL SELECT o_custkey, ceil(max(total) / 3.0)::BIGINT + 1 FROM n GROUP BY 1""",
)
def pages_until_empty(t):
    return paginate.pages_until_empty(_read(t), "source", "page_no", F.size("doc.list")).select("source", "page_no")


@query(
    "page_items",
    f"{PAGES_SQL} SELECT o_custkey AS source, ceil(i / 3.0)::BIGINT AS page_no, ((i - 1) % 3) AS position, o_orderkey AS item FROM n",
)
def page_items(t):
    kept = paginate.pages_with_total(_read(t), "source", "page_no", F.size("doc.list"), F.col("doc.total"))
    return paginate.page_items(kept, F.col("doc.list")).select(
        "source", "page_no", F.col("position").cast("long").alias("position"), "item"
    )


@query("page_number", f"{PAGES_SQL} SELECT o_orderkey AS id, i AS page, i - 1 AS page_zero FROM n")
def page_number(t):
    rows = numbered(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "page")
    return rows.select(F.col("o_orderkey").alias("id"), "page", (F.col("page") - 1).alias("page_zero"))


@query(
    "pages_by_cursor",
    f"""{PAGES_SQL} SELECT o_custkey AS source, ceil(i / 3.0)::BIGINT AS page_no, ceil(i / 3.0)::BIGINT - 1 AS hops FROM n GROUP BY ALL
    UNION ALL SELECT o_custkey, ceil(max(total) / 3.0)::BIGINT + 1, ceil(max(total) / 3.0)::BIGINT FROM n GROUP BY 1""",
)
def pages_by_cursor(t):
    # Every customer uses the tokens '1', '2', ...; the empty page names no next one.
    pages = _read(t).withColumn("token", F.col("page_no").cast("string"))
    onward = F.when(F.size("doc.list") > 0, (F.col("page_no") + 1).cast("string"))
    starts = t.orders.select(F.col("o_custkey").alias("source"), F.lit("1").alias("token")).distinct()
    met = paginate.pages_by_cursor(pages.select("source", "page_no", "token", onward.alias("next")), starts, "source", "token", F.col("next"))
    return met.select("source", "page_no", "hops")


@query(
    "request_cap",
    """WITH r AS (SELECT event_id, event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i,
      count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT run, event_id, i > 500 AS over_cap, n > 500 AS capped FROM r""",
)
def request_cap(t):
    return paginate.request_cap(t.events.select(F.col("event_type").alias("run"), "event_id"), "run", ["event_id"])


@query(
    "sort_packages",
    """WITH s AS (SELECT l_partkey AS slug, count(*) AS stars FROM lineitem GROUP BY 1)
    SELECT p_partkey AS slug, p_brand AS author, coalesce(stars, 0) AS stars FROM part LEFT JOIN s ON slug = p_partkey ORDER BY stars DESC, slug""",
)
def sort_packages(t):
    stars = star_counts(t.lineitem.select(F.col("l_partkey").alias("slug")), "slug")
    rows = t.packages.join(stars, "slug", "left").select("slug", "author", F.coalesce("stars", F.lit(0)).alias("stars"))
    return discovery.sort_packages(rows, "stars", "slug")


@query(
    "keyset_page",
    """WITH c AS (SELECT o_totalprice AS v, o_orderkey AS k FROM orders ORDER BY v DESC, k LIMIT 1 OFFSET 49),
      p AS (SELECT o_orderkey AS slug, o_totalprice AS stars FROM orders, c WHERE o_totalprice < v OR (o_totalprice = v AND o_orderkey > k)
        ORDER BY stars DESC, slug LIMIT 50)
    SELECT slug, stars, 'row' AS part FROM p UNION ALL (SELECT slug, stars, 'next' FROM p ORDER BY stars, slug DESC LIMIT 1)""",
)
def keyset_page(t):
    rows = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_totalprice").alias("stars"))
    _, cursor = discovery.keyset_page(rows, "stars", "slug", None, 50)
    last = cursor.first()
    page, following = discovery.keyset_page(rows, "stars", "slug", (last["stars"], last["slug"]), 50)
    return page.withColumn("part", F.lit("row")).unionByName(following.withColumn("part", F.lit("next")))


@query(
    "page_before",
    """WITH r AS (SELECT floor(epoch(ts) / 21600)::BIGINT AS b FROM events GROUP BY 1), m AS (SELECT avg(b * 21600000) AS x FROM r)
    SELECT 'sr-' || b AS id, b * 21600000 AS "at" FROM r, m WHERE b * 21600000 < x ORDER BY b DESC LIMIT 30""",
)
def page_before(t):
    middle = t.runs.agg(F.avg("at").alias("x")).select("x").scalar()
    return before(t.runs, middle, 30).select("id", "at")


@query(
    "topk_per_type",
    """WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) - 3 AS remaining FROM events)
    SELECT event_type, event_id, remaining FROM e WHERE i <= 3""",
)
def topk_per_type(t):
    return first_per_type(t.events.select("event_type", "event_id"), "event_type", ["event_id"])


VERSIONS_SQL = """WITH v AS MATERIALIZED (SELECT l_partkey AS slug, l_returnflag || l_linestatus AS recipe, l_suppkey AS output_ref, l_suppkey % 5 AS input_ref,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS version FROM lineitem),
    latest AS MATERIALIZED (SELECT * FROM v QUALIFY version = max(version) OVER (PARTITION BY slug))"""


@query("list_versions", f"{VERSIONS_SQL} SELECT slug, version, recipe FROM v ORDER BY slug, version")
def list_versions(t):
    return t.versions.orderBy("slug", "version").select("slug", "version", "recipe")


@query(
    "get_version",
    f"{VERSIONS_SQL} SELECT slug, version, recipe, 'latest' AS asked FROM latest UNION ALL SELECT slug, version, recipe, '2' FROM v WHERE version = 2",
)
def get_version(t):
    head = latest(t.versions, ["slug"]).withColumn("asked", F.lit("latest"))
    second = t.versions.filter(F.col("version") == 2).withColumn("asked", F.lit("2"))
    return head.unionByName(second).select("slug", "version", "recipe", "asked")


STARS_SQL = """WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS package, event_id, event_type FROM events WHERE event_type IN ('signup', 'error')),
    stars AS (SELECT user_id, package, max(event_id) AS event_id FROM e GROUP BY 1, 2 HAVING arg_max(event_type, event_id) = 'signup')"""


def star_events(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("signup", "error")).select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("package"), "event_id", "event_type"
    )


def stars(t: Tables) -> DataFrame:
    return star_state(star_events(t), "user_id", "package", ["event_id"], F.col("event_type") == "signup")


STARS_PER_PAGE = 5


def _star_pages_sql(direction: str, owner: str, member: str) -> str:
    return f"""SELECT '{direction}' AS direction, {owner} AS owner, page, {member} AS member, event_id,
      CASE WHEN page < max(page) OVER (PARTITION BY {owner}) THEN min(event_id) OVER (PARTITION BY {owner}, page) END AS next_cursor
    FROM (SELECT *, (row_number() OVER (PARTITION BY {owner} ORDER BY event_id DESC) - 1) // {STARS_PER_PAGE} AS page FROM stars)"""


@query("list_stars", f"{STARS_SQL} {_star_pages_sql('by user', 'user_id', 'package')} UNION ALL {_star_pages_sql('of package', 'package', 'user_id')}")
def list_stars(t):
    """All pages of what a user starred and of who starred a package, the latest first, with the cursor of the next."""
    rows, out = stars(t).withColumn("newest", -F.col("event_id")), None
    for direction, owner, member in (("by user", "user_id", "package"), ("of package", "package", "user_id")):
        pages = discovery.paged(rows, owner, "newest", STARS_PER_PAGE)
        fences = pages.fences.select(F.col("owner").alias("_owner"), F.col("page").alias("_page"), F.when(F.col("more"), -F.col("last")).alias("next_cursor"))
        of = F.col(owner).eqNullSafe(F.col("_owner")) & (F.col("page") == F.col("_page"))
        one = pages.rows.join(fences, of).select(F.lit(direction).alias("direction"), F.col(owner).alias("owner"), "page", F.col(member).alias("member"), "event_id", "next_cursor")
        out = one if out is None else out.unionByName(one)
    return out


@query("star_count", f"{STARS_SQL} SELECT package, count(*) AS stars FROM stars GROUP BY 1")
def star_count(t):
    return star_counts(stars(t), "package")


@query(
    "download_count",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS package, count(*) AS downloads FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1""",
)
def download_count(t):
    rows = t.events.withColumn("package", F.get_json_object("props", "$.k").cast("long"))
    return download_counts(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), "package")
