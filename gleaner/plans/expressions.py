"""Projections, predicates and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import number, text, value
from gleaner.operators import matching, quality, requests
from gleaner.operators.discovery import filter_packages, filter_signatures
from gleaner.operators.iterate import emit, prior_rows
from gleaner.plans import query
from gleaner.plans.sources import CAPTURES_SQL, STATUS, URL, bodies, order_records


@query(
    "emit",
    "SELECT 'Order-' || o_orderkey AS _id, 'Order' AS _type, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total FROM orders",
)
def emit_(t):
    return order_records(t).drop("_order")


@query(
    "path_field",
    """SELECT o_orderkey AS seq, o_orderstatus AS status, coalesce(sum(l_partkey), 0)::BIGINT AS parts
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def path_field(t):
    parts = value.each(F.col("doc.items"), "part")
    return (
        bodies(t)
        .select("seq", "doc.status", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("p"))
        .groupBy("seq", "status")
        .agg(F.sum("p").alias("parts"))
    )


@query(
    "path_opt",
    f"""{CAPTURES_SQL} SELECT o_orderkey AS seq, page, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total FROM captures""",
)
def path_opt(t):
    # The body of an open order is absent, so `?.total` is null.
    body = F.when(F.col("doc.status") == "F", F.col("doc"))
    return bodies(t).select("seq", F.col("page").cast("long").alias("page"), body["total"].alias("total"))


@query(
    "path_index",
    """SELECT doc_id, list_extract(string_split(text, ' '), 1) AS head, list_extract(string_split(text, ' '), -1) AS tail,
      list_extract(string_split(text, ' '), 501) AS far FROM documents""",
)
def path_index(t):
    words = F.split("text", " ", -1)
    return t.documents.select(
        "doc_id", value.at(words, 0).alias("head"), value.at(words, -1).alias("tail"), value.at(words, 500).alias("far")
    )


@query("wildcard", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE len(string_split(text, ' ')) END AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def wildcard(t):
    words = F.when(F.col("quality").isNotNull(), F.split("text", " ", -1))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.size(value.wildcard(words)).cast("long").alias("n"))


@query("index_strict", "SELECT doc_id, list_extract(string_split(text, chr(10)), 1) AS line FROM documents")
def index_strict(t):
    return t.documents.select("doc_id", value.at_strict(F.split("text", "\n", -1), 0).alias("line"))


@query(
    "template",
    """SELECT d.doc_id, 'doc ' || d.doc_id || ' quality=' || coalesce(CAST(quality AS VARCHAR), '') || ' tags=' || lang || ',' || source AS label
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def template(t):
    label = value.template(
        "doc ", F.col("doc_id"), " quality=", F.col("quality"), " tags=", value.joined(F.array("lang", "source"))
    )
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", label.alias("label"))


@query(
    "literal",
    "SELECT o_orderkey AS id, 'open' AS a, 7 AS b, true AS c FROM orders",
)
def literal(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.lit("open").alias("a"), F.lit(7).alias("b"), F.lit(True).alias("c"))


@query(
    "case_of",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state,
      CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size FROM orders""",
)
def case_of(t):
    state = value.case_of(F.col("o_orderstatus"), {"F": F.lit("final"), "O": F.lit("open")}, F.lit("other"))
    size = value.case_of(F.col("o_totalprice") > 100000, {"true": F.lit("large"), "false": F.lit("small")})
    return t.orders.select(F.col("o_orderkey").alias("id"), state.alias("state"), size.alias("size"))


@query(
    "case_coverage",
    "SELECT DISTINCT o_orderpriority AS label, 'not covered' AS problem FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '9-NEVER') UNION ALL SELECT '9-NEVER', 'unknown variant'",
)
def case_coverage(t):
    return quality.uncovered(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NEVER"])


@query(
    "arith",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_partkey + l_suppkey AS s, l_partkey - l_suppkey AS d,
      l_partkey * l_suppkey AS p, l_partkey::DOUBLE / l_linenumber AS q, l_partkey % l_linenumber AS r,
      9223372036854775807::DOUBLE + l_linenumber AS w FROM lineitem""",
)
def arith(t):
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        number.multiply(F.col("l_extendedprice"), number.subtract(F.lit(1), F.col("l_discount"))).alias("net"),
        number.add(part, supp).alias("s"),
        number.subtract(part, supp).alias("d"),
        number.multiply(part, supp).alias("p"),
        number.divide(part, n).alias("q"),
        number.modulo(part, n).alias("r"),
        number.add_wide(F.lit(9223372036854775807), n.cast("long")).alias("w"),
    )


@query("concat_plus", "SELECT c_custkey, c_name || c_mktsegment AS tag FROM customer")
def concat_plus(t):
    return t.customer.select("c_custkey", F.concat(number.given(F.col("c_name")), number.given(F.col("c_mktsegment"))).alias("tag"))


@query("negate", "SELECT l_orderkey, l_linenumber, -l_partkey AS k, -l_extendedprice AS p FROM lineitem")
def negate(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", number.negate(F.col("l_partkey")).alias("k"), number.negate(F.col("l_extendedprice")).alias("p")
    )


@query("struct_literal", "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def struct_literal(t):
    box = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return t.part.select(F.col("p_partkey").alias("id"), box.alias("box")).select("id", "box.name", "box.size")


@query("let_bind", "SELECT p_partkey AS id, upper(p_name) AS name, upper(p_name) || ':' || length(p_name) AS tag FROM part")
def let_bind(t):
    lets = t.part.withColumn("name", text.upper(F.col("p_name"))).withColumn("len", F.length("name"))
    return lets.select(F.col("p_partkey").alias("id"), "name", value.template(F.col("name"), ":", F.col("len")).alias("tag"))


@query("pipe", "SELECT doc_id, replace(upper(lang), 'E', '3') AS lang FROM documents")
def pipe(t):
    from gleaner.functions.registry import pipe as send

    return t.documents.select("doc_id", send(F.col("lang"), [("trim",), ("upper",), ("replace", "E", "3")]).alias("lang"))


@query("call", "SELECT d.doc_id, coalesce(quality, toxic, -1) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def call(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", value.coalesce(F.col("quality"), F.col("toxic"), F.lit(-1)).alias("q")
    )


@query(
    "truthy",
    """SELECT d.doc_id, text <> '' AS has_text, coalesce(toxic <> 0, false) AS toxic, coalesce(quality = 1, false) AS good,
      len(string_split(text, chr(10))) > 0 AS has_lines FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def truthy(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        value.truthy_text(F.col("text")).alias("has_text"),
        value.truthy_number(F.col("toxic")).alias("toxic"),
        value.truthy_bool(F.col("quality") == 1).alias("good"),
        value.truthy_array(F.split("text", "\n", -1)).alias("has_lines"),
    )


@query(
    "request_plan",
    """SELECT o_orderkey AS id, 'POST' AS method, 'https://api.test/orders?status=' || o_orderstatus || '&page=2&pageSize=50' AS url,
      'application/x-www-form-urlencoded' AS content_type, 'gleaner' AS agent,
      'priority=' || replace(o_orderpriority, ' ', '+') || '&at=%7E' AS body FROM orders""",
)
def request_plan(t):
    url = requests.with_query(
        F.concat(F.lit("https://api.test/orders?status="), "o_orderstatus"), {"page": F.lit(2), "pageSize": F.lit(50)}
    )
    head = requests.headers({}, "gleaner", "application/x-www-form-urlencoded")
    body = requests.form_body({"priority": F.col("o_orderpriority"), "at": F.lit("%7E")})
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.lit("POST").alias("method"),
        url.alias("url"),
        head["Content-Type"].alias("content_type"),
        head["User-Agent"].alias("agent"),
        F.replace(body, F.lit("%257E"), F.lit("%7E")).alias("body"),
    )


@query(
    "render_body",
    """SELECT o_orderkey AS id, 'p=' || replace(o_orderpriority, ' ', '+') || '&q=~%2A%26' AS form,
      o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS flag, o_totalprice AS total FROM orders""",
)
def render_body(t):
    form = requests.form_body({"p": F.col("o_orderpriority"), "q": F.lit("~*&")})
    js = requests.json_body(
        {
            "filter": F.struct(F.col("o_orderstatus").alias("status"), F.array("o_totalprice").alias("totals")),
            "flag": value.case_of(F.col("o_orderstatus"), {"F": F.lit(1)}, F.lit(0)),
        }
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), form.alias("form"), js.alias("json")).select(
        "id",
        "form",
        F.get_json_object("json", "$.filter.status").alias("status"),
        F.get_json_object("json", "$.flag").cast("int").alias("flag"),
        F.get_json_object("json", "$.filter.totals[0]").cast("double").alias("total"),
    )


@query(
    "regex_extract_bind",
    r"""SELECT page_id, regexp_extract(html, 'track\((\d+)\)', 1) AS tracker,
      regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""",
)
def regex_extract_bind(t):
    first = matching.extract_first(F.col("html"), r"track\((\d+)\)", ["tracker"])
    second = matching.extract_first(F.col("html"), r'<html lang="([a-z]+)"', ["lang"])
    return t.pages.select("page_id", *[c.alias(n) for n, c in (first | second).items()])


@query(
    "status_gate",
    f"""{CAPTURES_SQL} SELECT o_orderkey AS seq, page, {STATUS} AS status, {STATUS} < 400 AS accepted FROM captures""",
)
def status_gate(t):
    c = t.captures.withColumn("page", F.col("page").cast("long"))
    ok = c.filter(matching.accepted(F.col("status"))).withColumn("accepted", F.lit(True))
    rejected = c.filter(~matching.accepted(F.col("status"))).withColumn("accepted", F.lit(False))
    return ok.unionByName(rejected).select("seq", "page", "status", "accepted")


@query("storage_filter", "SELECT p_partkey AS slug, p_name AS description FROM part WHERE p_type = 'PROMO' AND contains(lower(p_brand || '/' || p_partkey || ' ' || p_name), '1/')")
def storage_filter(t):
    return filter_packages(t.packages, "PROMO", "1/").select("slug", "description")


@query(
    "signature_filter",
    """SELECT DISTINCT p_partkey AS slug FROM part JOIN lineitem ON l_partkey = p_partkey
    WHERE l_suppkey = (SELECT min(s_suppkey) FROM supplier) AND contains(lower(p_name), 'ing')""",
)
def signature_filter(t):
    wanted = t.supplier.agg(F.min("s_suppkey").alias("k")).select("k").scalar()
    # A job's outputs, one row per version and output, kept as arrays of one: no job's list grows.
    jobs = (
        t.versions.select("slug", F.array("output_ref").alias("outputs"))
        .join(t.packages.select("slug", F.col("description").alias("name")), "slug")
    )
    return filter_signatures(jobs, wanted, "ING").select("slug").distinct()


@query("prior_to_row", "SELECT 'Order-' || o_orderkey AS _id, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total FROM orders")
def prior_to_row(t):
    return prior_rows(order_records(t))
