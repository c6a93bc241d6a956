"""Checks on record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.value import epoch_micros
from gleaner.operators import quality
from gleaner.operators.counts import check_counts
from gleaner.plans import query
from gleaner.plans.history import EXPECTED, RUNS_SQL
from gleaner.plans.pages import RULES
from gleaner.plans.paging import VERSIONS_SQL
from gleaner.plans.sources import CATALOG
from gleaner.plans.tables import RUN_SECONDS


@query("dq_required", "SELECT 'quality' AS field, count(*) FILTER (quality IS NULL) AS nulls FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'lang', 0")
def dq_required(t):
    return quality.nulls_in(t.documents.join(t.labels, "doc_id", "left"), ["quality", "lang"])


@query("dq_enum", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def dq_enum(t):
    return quality.outside_enum(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("dq_unknown_field", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderdate']) AS field, (SELECT count(*) FROM orders) AS n")
def dq_unknown_field(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "o_custkey", "o_orderdate")
    names = quality.unknown_fields(rows, CATALOG, "Order")
    used = rows.agg(*[F.count(F.col(n)).alias(n) for n in names])
    return used.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("n")) for n in names])))


@query(
    "dq_ref",
    "SELECT l_orderkey AS seq, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW'",
)
def dq_ref(t):
    from gleaner.operators.refs import dangling
    from gleaner.plans.sources import line_records, order_records
    from gleaner.session import sized

    low = t.orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("id"))
    known = order_records(t).join(sized(low, t.orders.count(), "id"), "id", "left_anti")
    return dangling(line_records(t), "order", known, "Order", rows=t.lineitem.count()).select(F.get("_order", F.lit(0)).alias("seq"), "part")


@query(
    "dq_alignment",
    """WITH a AS (SELECT s_nationkey AS owner, CASE WHEN s_acctbal < 0 THEN '/N' || s_nationkey WHEN s_acctbal > 9000 THEN 'schema.org' ELSE 'schema.org/N' || s_suppkey % 3 END AS uri FROM supplier)
    SELECT DISTINCT owner, uri, 'malformed' AS problem FROM a WHERE uri LIKE '/%' OR uri NOT LIKE '%/%'
    UNION ALL SELECT owner, uri, 'duplicate' FROM a GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dq_alignment(t):
    uri = (
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit("/N"), "s_nationkey"))
        .when(F.col("s_acctbal") > 9000, F.lit("schema.org"))
        .otherwise(F.concat(F.lit("schema.org/N"), F.col("s_suppkey") % 3))
    )
    return quality.alignment_problems(t.supplier.select(F.col("s_nationkey").alias("owner"), uri.alias("uri")), "owner", "uri")


@query(
    "dq_dangling_type",
    "SELECT DISTINCT l_partkey AS owner, 'T' || l_suppkey AS ref FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0",
)
def dq_dangling_type(t):
    from gleaner.operators.typegraph import field_type_refs

    fields = t.lineitem.select(
        F.col("l_partkey").alias("owner"), F.concat(F.lit("Array(Ref(T"), "l_suppkey", F.lit("))")).alias("kind")
    ).distinct()
    declared = t.supplier.filter(F.col("s_acctbal") >= 0).select(F.concat(F.lit("T"), "s_suppkey").alias("name"))
    return quality.undeclared(field_type_refs(fields, "kind"), "ref", declared, "name").select("owner", "ref")


@query(
    "dq_type_ref",
    """WITH r AS (SELECT l_orderkey AS owner, CASE l_returnflag WHEN 'A' THEN 'acme' WHEN 'N' THEN 'n-corp' ELSE 'Bad Author' END AS author,
        CASE l_linestatus WHEN 'F' THEN 'T' ELSE 'u' END || l_suppkey AS name, l_linenumber - 1 AS version FROM lineitem)
    SELECT DISTINCT owner, author, name, CASE WHEN author = 'Bad Author' THEN 'author' WHEN name LIKE 'u%' THEN 'name' ELSE 'version' END AS problem
      FROM r WHERE author = 'Bad Author' OR name LIKE 'u%' OR version < 1
    UNION ALL SELECT owner, author, name, 'duplicate' FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def dq_type_ref(t):
    author = F.when(F.col("l_returnflag") == "A", F.lit("acme")).when(F.col("l_returnflag") == "N", F.lit("n-corp")).otherwise(F.lit("Bad Author"))
    name = F.concat(F.when(F.col("l_linestatus") == "F", F.lit("T")).otherwise(F.lit("u")), "l_suppkey")
    refs = t.lineitem.select(
        F.col("l_orderkey").alias("owner"), author.alias("author"), name.alias("name"), (F.col("l_linenumber") - 1).alias("version")
    )
    return quality.type_ref_problems(refs, "owner", "author", "name", "version")


@query(
    "dq_counts",
    f"""{RUNS_SQL} SELECT 'sr-' || b AS id, type, CASE WHEN type = 'view' THEN n + 1 ELSE -n END AS stored, n AS actual FROM c WHERE type IN ('view', 'error')""",
)
def dq_counts(t):
    # Views were stored one too high, errors with the wrong sign.
    wrong = F.transform_values(
        "counts", lambda k, v: F.when(k == "view", v + 1).when(k == "error", -v).otherwise(v)
    )
    actual = t.events.groupBy(
        F.concat(F.lit("sr-"), F.floor(epoch_micros(F.col("ts")) / (RUN_SECONDS * 1_000_000))).alias("id"),
        F.col("event_type").alias("type"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return quality.count_problems(t.runs.withColumn("counts", wrong), "counts", ["id"], actual)


RUN_SQL = "CASE WHEN {0} % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(
    "dq_stall_report",
    rf"""WITH e AS (SELECT {RUN_SQL.format("user_id")} AS run, event_type FROM events),
      c AS (SELECT run, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors,
        count(*) FILTER (event_type = 'refund') AS refunds, count(*) FILTER (event_type = 'signup') AS signups FROM e GROUP BY 1)
    SELECT run, 'unmet expectation' AS kind, (NOT views > 0)::INT + (NOT clicks >= 1000000000)::INT + (NOT refunds = 0)::INT + (NOT refunds > 0)::INT + (NOT errors <> 5)::INT + (NOT signups <= 1)::INT AS n FROM c
    UNION ALL SELECT {RUN_SQL.format("page_id")}, 'unmatched capture', count(*) FROM pages WHERE NOT (regexp_matches(url, 'example\.org') OR contains(url, '/en/') OR contains(url, '.html')) GROUP BY 1
    UNION ALL SELECT {RUN_SQL.format("d.doc_id")}, 'null field', count(*) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL GROUP BY 1
    UNION ALL SELECT 'all', 'unfired rule', 1""",
)
def dq_stall_report(t):
    """What went wrong in each run, by kind; two runs, told by the parity of ids. Rules are shared by all runs."""
    from gleaner.operators.counts import check_counts_by
    from gleaner.operators.matching import unfired_rules, unmatched_captures

    run = lambda c: F.when(F.col(c) % 2 == 0, "even").otherwise("odd")
    report = quality.report_by_run(
        **{
            "unmet expectation": check_counts_by(t.events.withColumn("run", run("user_id")), "run", EXPECTED, "event_type").filter(~F.col("met")),
            "unfired rule": unfired_rules(t.pages, RULES).withColumn("run", F.lit("all")),
            "unmatched capture": unmatched_captures(t.pages, RULES).select(run("page_id").alias("run"), "page_id", "url"),
            "null field": t.documents.join(t.labels, "doc_id", "left").where(F.col("quality").isNull()).select(run("doc_id").alias("run"), "doc_id"),
        }
    )
    return report.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "golden_update",
    f"""{VERSIONS_SQL}, g AS (SELECT output_ref, count(*) AS n FROM latest GROUP BY 1), o AS (SELECT output_ref, count(*) AS n FROM v WHERE version = 1 GROUP BY 1)
    SELECT *, 'removed' AS change, 1 AS copies, 'different' AS state FROM (FROM o EXCEPT FROM g)
    UNION ALL SELECT *, 'added', 1, 'different' FROM (FROM g EXCEPT FROM o)
    UNION ALL SELECT *, 'golden', 1, 'written,equal' FROM o""",
)
def golden_update(t):
    """First versions as the golden snapshot: written, compared with itself, then with the latest versions."""
    from gleaner.operators.diff import golden
    from gleaner.operators.publishing import latest
    from gleaner.session import new_path

    refs = lambda v: v.groupBy("output_ref").agg(F.count(F.lit(1)).alias("n"))
    path = new_path(t.spark, "golden")
    first = refs(t.versions.where("version = 1"))
    states = [golden(t.spark, path, first)[0], golden(t.spark, path, first)[0]]
    state, rows = golden(t.spark, path, refs(latest(t.versions, ["slug"])))
    kept = t.spark.read.parquet(path).withColumns({"change": F.lit("golden"), "copies": F.lit(1).cast("long"), "state": F.lit(",".join(states))})
    return rows.withColumn("state", F.lit(state)).unionByName(kept)
