"""Loops, order, ids and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import refs
from gleaner.operators.iterate import for_each, for_each_variant, with_record_ids
from gleaner.plans import query
from gleaner.plans.sources import bodies, envelopes, line_records, order_records

LINES = "SELECT l_orderkey AS seq, l_linenumber AS n, l_partkey AS part, l_quantity AS qty FROM lineitem"


@query("for_each", LINES)
def for_each_(t):
    rows = for_each(bodies(t).select("seq", "doc"), F.col("doc.items"), "item")
    return rows.select("seq", "item.n", "item.part", "item.qty")


@query("for_each_variant", LINES)
def for_each_v(t):
    from gleaner.sources.captures import decode_body

    docs = t.captures.select("seq", decode_body(F.col("response_headers"), F.col("body"))["value"].alias("v"))
    rows = for_each_variant(docs, F.try_variant_get("v", "$.items", "variant"), "item")
    return rows.select(
        "seq",
        F.variant_get("item", "$.n", "int").alias("n"),
        F.variant_get("item", "$.part", "bigint").alias("part"),
        F.variant_get("item", "$.qty", "double").alias("qty"),
    )


@query(
    "for_each_nested",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
    SELECT doc_id, i, generate_subscripts(string_split(line, ' '), 1) - 1 AS j, unnest(string_split(line, ' ')) AS word FROM l""",
)
def for_each_nested(t):
    lines = for_each(t.documents.select("doc_id", "text"), F.split("text", "\n", -1), "line", at="i").drop("text")
    words = for_each(lines, F.split("line", " ", -1), "word", at="j")
    return words.select("doc_id", F.col("i").cast("long"), F.col("j").cast("long"), "word")


@query(
    "sample_top_level",
    """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
      l_partkey FROM lineitem) SELECT l_orderkey AS seq, l_partkey AS part FROM l WHERE (i - 1) % 50 < 2""",
)
def sample_top_level(t):
    rows = for_each(bodies(t).select("seq", "doc"), F.col("doc.items"), "item", sample=2)
    return rows.select("seq", "item.part")


@query(
    "emission_order",
    """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
    SELECT 'Order' AS type, CAST(o_orderkey AS VARCHAR) AS place FROM orders UNION ALL SELECT 'Line', l_orderkey || '.0.' || (i - 1) FROM l""",
)
def emission_order(t):
    return envelopes(t).orderBy("_order").select(
        F.col("_type").alias("type"), F.array_join(F.col("_order").cast("array<string>"), ".").alias("place")
    )


@query(
    "record_id",
    """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
      a AS (SELECT 'Order' AS type, o_orderkey AS k, 0 AS i FROM orders UNION ALL SELECT 'Line', k, i FROM l)
    SELECT type, k AS seq, i AS nth, 'rec-' || (row_number() OVER (ORDER BY k, i) - 1) AS rec_id FROM a""",
)
def record_id(t):
    at = F.col("_order")
    # Ids depend on the order alone, so the fields are not moved with it.
    return with_record_ids(envelopes(t).select("_type", "_order")).select(
        F.col("_type").alias("type"),
        F.get(at, F.lit(0)).alias("seq"),
        F.coalesce(F.get(at, F.lit(2)) + 1, F.lit(0)).alias("nth"),
        "rec_id",
    )


@query("ref_bind", "SELECT l_orderkey AS seq, 'Order-' || l_orderkey AS _ref, 'Order' AS _type, l_partkey AS part FROM lineitem")
def ref_bind(t):
    return line_records(t).select(F.get("_order", F.lit(0)).alias("seq"), "order._ref", "order._type", "part")


@query(
    "ref_resolve",
    "SELECT l_partkey AS part, o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def ref_resolve(t):
    return refs.resolve(line_records(t), "order", order_records(t)).select(
        "part", F.col("parent_id").alias("order_id"), F.col("parent_status").alias("status"), F.col("parent_total").alias("total")
    )


@query(
    "ref_integrity",
    """SELECT l_orderkey AS seq, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
    UNION ALL SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_quantity >= 50""",
)
def ref_integrity(t):
    # Parents of pending orders are gone; large lines point at another type.
    parents = order_records(t).filter(F.col("status") != "P")
    other = F.struct(F.col("order._ref").alias("_ref"), F.lit("Invoice").alias("_type"))
    lines = line_records(t).withColumn("order", F.when(F.col("qty") >= 50, other).otherwise(F.col("order")))
    return refs.dangling(lines, "order", parents, "Order", rows=t.lineitem.count()).select(F.get("_order", F.lit(0)).alias("seq"), "part")


@query(
    "bind_prior",
    "SELECT o_orderkey AS id, round(o_totalprice / m.avg_total, 6) AS share FROM orders, (SELECT max(o_totalprice) AS avg_total FROM orders) m",
)
def bind_prior(t):
    # The prior stage emits exactly one record, which every order sees.
    prior = t.orders.agg(F.max("o_totalprice").alias("top"))
    bound = refs.bind_single(t.orders, prior, "prior")
    return bound.select(
        F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / F.col("prior.top"), 6).alias("share")
    )


