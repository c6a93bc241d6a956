"""Entity enrichment, discovery and registry joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import discovery, enrich, publishing
from gleaner.operators.counts import count_by_type
from gleaner.plans import query
from gleaner.plans.paging import VERSIONS_SQL
from gleaner.plans.tables import Tables
from gleaner.session import new_path, sized
from gleaner.sources import lookup


def entity_payloads(t: Tables) -> DataFrame:
    """A JSON entity per nation: label, region as an item, customers as a quantity, a place, and deleted nations."""
    customers = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    snak = lambda kind, datatype, value: F.struct(
        F.struct(
            F.lit(kind).alias("snaktype"), F.lit(datatype).alias("datatype"), F.struct(value.alias("value")).alias("datavalue")
        ).alias("mainsnak")
    )
    region = F.struct(F.concat(F.lit("R"), "n_regionkey").alias("id"))
    amount = F.struct(F.concat(F.lit("+"), "n").alias("amount"))
    spot = F.struct(F.col("n_nationkey").alias("latitude"), F.col("n_regionkey").alias("longitude"))
    claims = F.struct(
        F.array(snak("value", "wikibase-item", region)).alias("P1"),
        F.when(F.col("n_regionkey") != 0, F.array(snak("value", "quantity", amount))).alias("P2"),
        F.array(snak("value", "globe-coordinate", spot)).alias("P3"),
        F.array(snak("novalue", "string", F.lit("x"))).alias("P4"),
    )
    en = F.struct(F.struct(F.col("n_name").alias("value")).alias("en"))
    gone = F.when(F.col("n_regionkey") == 4, F.lit(""))
    return (
        t.nation.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .filter(F.col("n_regionkey") != 3)
        .select("n_nationkey", F.to_json(F.struct(en.alias("labels"), claims.alias("claims"), gone.alias("missing"))).alias("json"))
    )


@query(
    "entity_enrich",
    """WITH n AS (SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation WHERE n_regionkey <> 3)
    SELECT c_custkey, n_name AS entity_label, 'R' || n_regionkey AS region, CASE WHEN n_regionkey <> 0 THEN '+' || c END AS customers,
      n_nationkey || ',' || n_regionkey AS place, NULL::VARCHAR AS nothing,
      CASE WHEN n_name IS NULL THEN 'entity not present' WHEN n_regionkey = 4 THEN 'entity is missing' END AS enrich_error
    FROM customer LEFT JOIN n ON n_nationkey = c_nationkey""",
)
def entity_enrich(t):
    table = enrich.entities(entity_payloads(t), "n_nationkey", "json")
    wanted = {"region": "P1", "customers": "P2", "place": "P3", "nothing": "P4"}
    rows = t.customer.select("c_custkey", "c_nationkey")
    return enrich.enrich(rows, "c_nationkey", table, wanted).drop("c_nationkey")


@query("en_label", "SELECT n_nationkey AS key, n_name AS label, NULL::VARCHAR AS description FROM nation WHERE n_regionkey <> 3")
def en_label(t):
    return enrich.entities(entity_payloads(t), "n_nationkey", "json").select("key", "label", "description")


@query("fn_table", "SELECT s_suppkey, CASE WHEN n_regionkey <> 3 THEN n_name END AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def fn_table(t):
    """A transform that consults an entity source: payloads kept by key range, of which the needed ranges are read."""
    path = new_path(t.spark, "lookup")
    lookup.write_lookup(entity_payloads(t), "n_nationkey", path, 5)
    rows = t.supplier.select("s_suppkey", "s_nationkey")
    source = lookup.read_lookup(t.spark, path, "n_nationkey", 5, "n_nationkey long, json string")
    table = enrich.entities(lookup.needed(source, "n_nationkey", rows, "s_nationkey"), "n_nationkey", "json")
    return enrich.enrich(rows, "s_nationkey", table, {}).select("s_suppkey", F.col("entity_label").alias("nation"))


@query("latest_join", f"{VERSIONS_SQL} SELECT slug, version, recipe, output_ref FROM latest")
def latest_join(t):
    return publishing.latest(t.versions, ["slug"]).select("slug", "version", "recipe", "output_ref")


@query(
    "status_outer_join",
    """WITH d AS (SELECT p_partkey::VARCHAR AS name, CASE WHEN p_type = 'ECONOMY' THEN 'broken' ELSE 'valid' END AS draft FROM part WHERE p_type <> 'PROMO'),
      v AS (SELECT l_partkey::VARCHAR AS name, count(*) AS deployed_version FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT name, coalesce(draft, 'missing') AS draft, deployed_version FROM d FULL JOIN v USING (name)""",
)
def status_outer_join(t):
    name = F.col("p_partkey").cast("string")
    drafts = t.part.filter(~F.col("p_type").isin("PROMO", "ECONOMY")).select(name.alias("name"))
    broken = t.part.filter(F.col("p_type") == "ECONOMY").select(F.concat(F.lit("jobs/"), name, F.lit(".job")).alias("path"))
    live = (
        t.lineitem.filter(F.col("l_returnflag") != "R")
        .groupBy(F.col("l_partkey").cast("string").alias("name"))
        .agg(F.count(F.lit(1)).alias("version"))
    )
    return discovery.statuses(drafts, broken, live)


@query(
    "discover_join",
    f"""{VERSIONS_SQL}, d AS (SELECT output_ref, input_ref, slug, p_brand AS author, p_type AS category, version FROM latest JOIN part ON p_partkey = slug)
    SELECT output_ref, slug, author, category, version, 'any' AS pinned FROM d UNION ALL SELECT output_ref, slug, author, category, version, '2' FROM d WHERE input_ref = 2""",
)
def discover_join(t):
    """Producers of each type, and those whose latest version pins the second version of its input."""
    index = discovery.latest_index(t.versions, ["slug"], "output_ref")
    of = lambda pinned, exact: discovery.discover(index, t.packages, t.versions, "slug", exact).withColumn("pinned", F.lit(pinned))
    rows = of("any", None).unionByName(of("2", F.col("input_ref") == 2))
    return rows.select("output_ref", "slug", "author", "category", "version", "pinned")


PINS_SQL = "p AS (SELECT DISTINCT slug, output_ref AS name FROM v)"


@query(
    "role_partition",
    f"""{VERSIONS_SQL}, {PINS_SQL}
    SELECT slug, name, 'output' AS role FROM p JOIN latest USING (slug) WHERE name = output_ref
    UNION ALL SELECT slug, name, 'input' FROM p JOIN latest USING (slug) WHERE name = input_ref""",
)
def role_partition(t):
    # Few pins play a part, so what repeats is dropped afterwards.
    pins = sized(t.versions.select("slug", F.col("output_ref").alias("name")), t.versions.count(), "slug", "name")
    head = publishing.latest(t.versions, ["slug"])
    found = discovery.roles(
        pins,
        head.select("slug", F.col("input_ref").alias("name")),
        head.select("slug", F.col("output_ref").alias("name")),
        ["slug", "name"],
    )
    return found.distinct()


@query(
    "pin_check",
    f"""{VERSIONS_SQL}, d AS (SELECT slug, output_ref AS name, max(version) AS declared FROM v WHERE recipe <> 'RF' GROUP BY 1, 2)
    SELECT l.slug, output_ref AS name, version, declared AS declared_version,
      CASE WHEN declared IS NULL THEN 'not declared' ELSE 'other version' END AS problem
    FROM v l LEFT JOIN d ON d.slug = l.slug AND d.name = l.output_ref WHERE declared IS NULL OR declared <> version""",
)
def pin_check(t):
    pins = t.versions.select("slug", F.col("output_ref").alias("name"), "version", "recipe")
    declared = pins.filter(F.col("recipe") != "RF").groupBy("slug", "name").agg(F.max("version").alias("version"))
    return discovery.pin_problems(declared, pins, "slug", "name", "version")


@query("producers_index", f"{VERSIONS_SQL} SELECT output_ref, slug FROM latest")
def producers_index(t):
    return discovery.latest_index(t.versions, ["slug"], "output_ref").select("output_ref", "slug")


@query("consumers_index", f"{VERSIONS_SQL} SELECT input_ref, slug FROM latest")
def consumers_index(t):
    return discovery.latest_index(t.versions, ["slug"], "input_ref").select("input_ref", "slug")


@query(
    "aligned_index",
    "SELECT CASE s_nationkey % 5 WHEN 0 THEN 'schema.org' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'foaf' WHEN 3 THEN 'dublin-core' ELSE 'other' END || '/N' || s_nationkey AS term, 'T' || s_suppkey AS name FROM supplier",
)
def aligned_index(t):
    from gleaner.plans.sources import type_alignments

    rows = type_alignments(t).withColumn("terms", F.array(F.concat("ontology", F.lit("/"), "term")))
    return discovery.latest_index(rows, ["name"], "terms").select(F.col("terms").alias("term"), "name")


@query(
    "extends_index",
    """SELECT 'a' || p.s_nationkey || '/T' || p.s_suppkey || '@' || CASE WHEN p.s_acctbal > 5000 THEN 2 ELSE 1 END AS parent, 'T' || c.s_suppkey AS name
    FROM supplier c JOIN supplier p ON p.s_suppkey = c.s_suppkey // 2 WHERE c.s_suppkey > 1""",
)
def extends_index(t):
    parents = t.types.select(
        F.col("key").alias("parent_key"), F.concat("author", F.lit("/"), "name", F.lit("@"), "version").alias("parent_pin")
    )
    rows = t.types.join(parents, F.col("parent") == F.col("parent_key")).select("name", "version", "parent_pin")
    return discovery.latest_index(rows, ["name"], "parent_pin").select(F.col("parent_pin").alias("parent"), "name")


@query(
    "user_index",
    """WITH m AS (SELECT p_brand AS author, 'package' AS kind, p_partkey::VARCHAR AS member FROM part
      UNION SELECT 'a' || s_nationkey, 'type', 'T' || s_suppkey FROM supplier
      UNION SELECT p_brand, 'type', p_type FROM part)
    SELECT *, count(*) OVER (PARTITION BY author, kind) AS total FROM m""",
)
def user_index(t):
    """Packages and types of each author; a package's category counts as a type its author uses."""
    types = t.types.select("author", F.col("name").alias("member")).unionByName(t.packages.select("author", F.col("category").alias("member")))
    return discovery.members_by_author(package=t.packages.select("author", F.col("slug").alias("member")), type=types)


@query("category_list", "SELECT DISTINCT p_type AS category FROM part")
def category_list(t):
    return t.packages.select("category").distinct()


@query("emit_types", "SELECT DISTINCT event_type AS type FROM events")
def emit_types(t):
    return t.events.select(F.col("event_type").alias("type")).distinct()


@query("fork_count", f"{VERSIONS_SQL}, f AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS slug, user_id FROM events WHERE event_type = 'purchase') SELECT slug, count(*) AS forks FROM f JOIN latest USING (slug) GROUP BY 1")
def fork_count(t):
    made = publishing.forks(_owned(t), t.versions, _fork_requests(t), "slug", "owner")
    return made.groupBy("slug").agg(F.count(F.lit(1)).alias("forks"))


@query(
    "fork_copy",
    f"""{VERSIONS_SQL}, f AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS slug, user_id FROM events WHERE event_type = 'purchase')
    SELECT slug, 'u' || user_id AS owner, version AS from_version, recipe, 1 AS version FROM f JOIN latest USING (slug)""",
)
def fork_copy(t):
    return publishing.forks(_owned(t), t.versions, _fork_requests(t), "slug", "owner")


def _owned(t: Tables) -> DataFrame:
    return t.packages.select("slug", F.col("author").alias("owner"))


def _fork_requests(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select(
        F.get_json_object("props", "$.k").cast("long").alias("slug"), F.concat(F.lit("u"), "user_id").alias("owner")
    )


@query(
    "profile_counts",
    """WITH p AS (SELECT c_custkey::VARCHAR AS u, count(*) AS packages FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
      s AS (SELECT user_id::VARCHAR AS u, count(*) AS stars FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS package FROM events WHERE event_type = 'view') GROUP BY 1)
    SELECT u AS "user", coalesce(packages, 0) AS packages, coalesce(stars, 0) AS stars
    FROM (SELECT u FROM p UNION SELECT u FROM s UNION SELECT c_custkey::VARCHAR FROM customer) LEFT JOIN p USING (u) LEFT JOIN s USING (u)""",
)
def profile_counts(t):
    starred = (
        t.events.filter("event_type = 'view'")
        .select("user_id", F.get_json_object("props", "$.k").cast("long").alias("package"))
        .distinct()
    )
    known = t.customer.select(F.col("c_custkey").alias("user"))
    return publishing.profile_counts(t.orders, "o_custkey", starred, "user_id", known)


@query("count_by_type", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def count_by_type_(t):
    return count_by_type(t.events.select(F.col("event_type").alias("type")), "type")
