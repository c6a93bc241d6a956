"""Sources and sinks: captures, bodies, the record store, snapshots and JSON-LD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.value import epoch_micros
from gleaner.operators import quality
from gleaner.operators.iterate import emit, envelope, for_each, ref
from gleaner.operators.ordered import as_of
from gleaner.plans import query
from gleaner.plans.tables import ORDER_BODY, Tables
from gleaner.session import new_path
from gleaner.sources import captures as C
from gleaner.sources import inputs, jsonld, store
from gleaner.types import Catalog, Enum, Field, RecordType, Ref, check_emit

CATALOG = Catalog.of(
    [
        RecordType(
            "Order",
            (
                Field("id", T.LongType(), alignment="schema.org/orderNumber"),
                Field("status", Enum("Status", ("F", "O", "P"))),
                Field("total", T.DoubleType(), alignment="schema.org/price"),
            ),
            ("schema.org/Order",),
        ),
        RecordType(
            "Line",
            (
                Field("order", Ref("Order")),
                Field("n", T.IntegerType()),
                Field("part", T.LongType()),
                Field("qty", T.DoubleType(), optional=True),
                Field("price", T.DoubleType(), optional=True),
            ),
        ),
    ]
)

# Text of the URL and status of an order capture, for the SQL twins.
URL = (
    "'https://api.test/orders/' || o_orderkey || '?b=' || replace(o_orderpriority, ' ', '+') || '&a=' || o_orderstatus"
)
STATUS = "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 404 ELSE 200 END"


# Orders once for each of their captures: fifty lines to a page, one page at least.
CAPTURES_SQL = """WITH captures AS (SELECT o.*, unnest(range(greatest(1, ceil(coalesce(n, 0) / 50.0)::BIGINT))) AS page
      FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def bodies(t: Tables) -> DataFrame:
    """Order captures with their body read by its declared schema."""
    return t.run_captures.withColumn("doc", F.from_json("body", ORDER_BODY))


def order_records(t: Tables, keep: tuple[str, ...] = ()) -> DataFrame:
    d = bodies(t).filter(F.col("page") == 0)
    doc = F.col("doc")
    return emit(d, "Order", {n: doc[n] for n in ("id", "status", "total")}, [F.col("seq")], keep)


def line_records(t: Tables, keep: tuple[str, ...] = ()) -> DataFrame:
    d = bodies(t).withColumn("parent", ref("Order", [F.col("seq")])).select("seq", "page", "parent", "doc.items", *keep)
    lines = for_each(d, F.col("items"), "item", at="i")
    item = F.col("item")
    return emit(
        lines,
        "Line",
        {"order": F.col("parent"), **{n: item[n] for n in ("n", "part", "qty", "price")}},
        [F.col("seq"), F.col("page"), F.col("i")],
        keep,
    )


def envelopes(t: Tables) -> DataFrame:
    return envelope(order_records(t)).unionByName(envelope(line_records(t)))


def _lines_file(t: Tables, broken: bool) -> str:
    """Captures as JSON lines; with `broken`, each rejected one also leaves a torn line."""
    path = new_path(t.spark, "jsonl")
    if not broken:
        C.write_captures(t.captures.drop("page"), path)
        return path
    good = t.captures.select(F.to_json(F.struct(*[c for c in t.captures.columns if c != "page"])).alias("value"))
    torn = t.captures.filter(F.col("status") == 404).select(F.concat(F.lit('{"kind": "http", "seq": '), "seq").alias("value"))
    good.unionByName(torn).write.text(path, compression="gzip")
    return path


@query(
    "read_captures",
    f"""SELECT {URL} AS url, {STATUS} AS status, 'good' AS part FROM orders
    UNION ALL SELECT '{{"kind": "http", "seq": ' || o_orderkey, NULL, 'torn' FROM orders WHERE {STATUS} = 404""",
)
def read_captures(t):
    good, bad = C.quarantine(C.read_captures(t.spark, _lines_file(t, True), strict=False))
    return good.select("url", "status", F.lit("good").alias("part")).unionByName(
        bad.select(F.col("line").alias("url"), F.lit(None).cast("int").alias("status"), F.lit("torn").alias("part"))
    )


@query(
    "bad_capture_lines",
    """WITH l AS (SELECT event_id // 1000 AS file, event_type, event_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line FROM events)
    SELECT file, line, '{"kind": "http", "seq": ' || event_id AS value FROM l WHERE event_type = 'error'""",
)
def bad_capture_lines(t):
    """Files of a thousand event captures each, torn where an event is an error."""
    path = new_path(t.spark, "torn")
    whole = F.to_json(F.struct(F.lit("http").alias("kind"), F.col("event_id").alias("seq"), F.col("props").alias("body")))
    torn = F.concat(F.lit('{"kind": "http", "seq": '), "event_id")
    lines = t.events.select("event_id", F.floor(F.col("event_id") / 1000).alias("part"), F.when(F.col("event_type") == "error", torn).otherwise(whole).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    found = C.bad_lines(t.spark, path)
    return found.select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("file"), "line", "value")


@query(
    "read_inputs",
    """SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey
    WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING' AND n_regionkey IN (SELECT min(r_regionkey) FROM region UNION SELECT max(r_regionkey) FROM region) GROUP BY 1""",
)
def read_inputs(t):
    """An inputs file with two constants and a list of nations, bound to a job over customers."""
    path = new_path(t.spark, "inputs")
    ends = t.region.agg(F.min("r_regionkey").alias("a"), F.max("r_regionkey").alias("b"))
    listed = t.nation.join(ends, F.col("n_regionkey").isin(F.col("a"), F.col("b"))).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    one = listed.agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("nations"))
    one.select(F.to_json(F.struct(F.lit("BUILDING").alias("segment"), F.lit(1000).alias("least"), "nations")).alias("value")).coalesce(1).write.text(path)
    given = inputs.constants(inputs.read_inputs(t.spark, path))
    nations = inputs.table(t.spark, path, "nations", "id long, name string")
    wanted = t.customer.where((F.col("c_mktsegment") == given["segment"]) & (F.col("c_acctbal") > given["least"]))
    rows = wanted.join(nations, F.col("c_nationkey") == F.col("id")).groupBy(F.col("name").alias("nation"))
    return rows.agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "parse_captures",
    f"SELECT o_orderkey AS seq, 'GET' AS method, {URL} AS url, 'application/json; charset=utf-8' AS content_type FROM orders",
)
def parse_captures(t):
    lines = t.captures.select(F.to_json(F.struct(*t.captures.columns)).alias("line"))
    return C.parse_captures(lines).select(
        "seq", "method", "url", F.try_element_at("response_headers", F.lit("Content-Type")).alias("content_type")
    )


@query(
    "write_captures",
    f"""SELECT {STATUS} AS status, count(*) AS n, count(DISTINCT o_orderkey) AS urls FROM orders GROUP BY 1""",
)
def write_captures(t):
    back = C.read_captures(t.spark, _lines_file(t, False))
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


@query(
    "split_captures",
    f"""SELECT 'http' AS part, {URL} AS url FROM orders
    UNION ALL SELECT 'match', 'https://app.test/' || event_type || '?user=' || user_id FROM events
    UNION ALL SELECT 'document', url FROM pages""",
)
def split_captures(t):
    mixed = t.captures.drop("page").unionByName(t.web_captures, allowMissingColumns=True)
    parts = {"http": C.http, "match": C.matches, "document": C.documents}
    out = [f(mixed).select(F.lit(n).alias("part"), "url") for n, f in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("read_documents", "SELECT page_id, url, length(html) AS chars FROM pages")
def read_documents(t):
    return C.documents(t.web_captures).select(
        F.col("seq").alias("page_id"), "url", F.char_length("html").cast("long").alias("chars")
    )


@query(
    "decode_body",
    """SELECT event_id AS id,
      CASE WHEN event_type IN ('click', 'view') THEN 'json' WHEN event_type = 'signup' THEN 'html' ELSE 'text' END AS format,
      CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
      CASE WHEN event_type IN ('purchase', 'signup') THEN props WHEN event_type = 'error' THEN 'no json' END AS text
    FROM events""",
)
def decode_body(t):
    # A header for each way of being read: JSON, HTML, plain text, and none at all.
    kind = F.col("event_type")
    headers = (
        F.when(kind == "click", F.create_map(F.lit("content-TYPE"), F.lit("application/vnd.x+json; v=1")))
        .when(kind == "signup", F.create_map(F.lit("Content-Type"), F.lit("TEXT/HTML; charset=utf-8")))
        .when(kind == "purchase", F.create_map(F.lit("Content-Type"), F.lit("text/plain")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    body = F.when(kind == "error", F.lit("no json")).otherwise(F.col("props"))
    return t.events.select(F.col("event_id").alias("id"), C.decode_body(headers, body).alias("b")).select(
        "id", "b.format", F.try_variant_get("b.value", "$.k", "bigint").alias("k"), "b.text"
    )


@query("content_type", "SELECT 'application/json' AS mime, count(*) AS n FROM orders")
def content_type(t):
    return t.captures.groupBy(C.content_type(F.col("response_headers")).alias("mime")).agg(F.count(F.lit(1)).alias("n"))


RUN_OF = "CAST(year(o_orderdate) AS VARCHAR)"


def _store(t: Tables) -> str:
    """All records of all orders, one run per order year."""

    def make():
        base = new_path(t.spark, "store")
        # A capture tells its run, so records are not joined with orders again.
        orders, lines = order_records(t, ("run",)), line_records(t, ("run",))
        store.write_records(
            {"Order": orders.withColumnRenamed("run", "_run"), "Line": lines.withColumnRenamed("run", "_run")},
            base,
            F.col("_run"),
            1700000000000,
        )
        return base

    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _stores:
        _stores[key] = make()
    return _stores[key]


_stores: dict[tuple, str] = {}


@query(
    "write_records",
    f"""SELECT 'Order' AS type, {RUN_OF} AS run, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2
    UNION ALL SELECT 'Line', {RUN_OF}, count(*), round(sum(l_extendedprice), 2)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2""",
)
def write_records(t):
    base = _store(t)
    out = None
    for name, amount in (("Order", "total"), ("Line", "price")):
        part = (
            store.load_records(t.spark, base, name, ordered=False)
            .groupBy(F.col("_scheduled_run_id").alias("run"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), 2).alias("total"))
            .select(F.lit(name).alias("type"), "run", "n", "total")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "load_records",
    f"""SELECT 'Order-' || o_orderkey AS _id, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total
    FROM orders WHERE {RUN_OF} = '1997'""",
)
def load_records(t):
    return store.load_records(t.spark, _store(t), "Order", "1997").drop("_run")


@query(
    "load_run_snapshot",
    f"""SELECT 'Order' AS _type, o_orderkey AS order_key, o_totalprice AS amount, NULL AS parent FROM orders WHERE {RUN_OF} = '1997'
    UNION ALL SELECT 'Line', l_orderkey, l_extendedprice, 'Order-' || l_orderkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {RUN_OF} = '1997'""",
)
def load_run_snapshot(t):
    snap = store.load_run_snapshot(t.spark, _store(t), ["Order", "Line"], "1997")
    f = F.col("fields")
    return snap.select(
        "_type",
        F.get("_order", F.lit(0)).alias("order_key"),
        F.coalesce(F.get_json_object(f, "$.total"), F.get_json_object(f, "$.price")).cast("double").alias("amount"),
        F.get_json_object(f, "$.order._ref").alias("parent"),
    )


@query(
    "run_to_store",
    f"""WITH v AS (SELECT l_partkey AS job, l_shipdate AS published, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS version FROM lineitem),
      r AS (SELECT {RUN_OF} AS run, l_partkey AS job, make_date({RUN_OF}::INTEGER, 7, 1) AS at, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
    SELECT run, job, 'Line' AS type, n, (SELECT max(version) FROM v WHERE v.job = r.job AND v.published <= r.at) AS version FROM r""",
)
def run_to_store(t):
    """What each run stored of a job's records, with the version of the job that was deployed when it ran."""
    rows = store.load_records(t.spark, _store(t), "Line", ordered=False)
    held = rows.groupBy(F.col("_scheduled_run_id").alias("run"), F.col("part").alias("job")).agg(F.count(F.lit(1)).alias("n"))
    runs = held.withColumn("at", epoch_micros(F.make_date(F.col("run").cast("int"), F.lit(7), F.lit(1))))
    deployed = t.versions.select(F.col("slug").alias("job"), F.col("published_at").alias("at"), "version")
    met = as_of(runs, deployed, "job", "at", ["version"], ["run"], ["version"])
    return met.select("run", "job", F.lit("Line").alias("type"), "n", "version")


@query(
    "ephemeral_output",
    "SELECT o_orderstatus AS status, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def ephemeral_output(t):
    store.ephemeral({"Order": order_records(t), "Line": line_records(t)}, "run_")
    return t.spark.sql(
        """SELECT o.status, count(*) AS lines, round(sum(l.price), 2) AS price
        FROM run_Line l JOIN run_Order o ON l.`order`._ref = o._id GROUP BY o.status"""
    )


@query(
    "bind_column",
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS status,
      CAST(trunc(o_totalprice) AS BIGINT) AS total, CAST(o_orderkey AS VARCHAR) AS label,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'status' END AS _bind_error FROM orders""",
)
def bind_column(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderkey").cast("double").alias("label"),
    )
    wanted = T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("status", T.StringType(), False),
            T.StructField("total", T.LongType()),
            T.StructField("label", T.StringType()),
        ]
    )
    return quality.bind_columns(rows, wanted, strict=False)


@query(
    "emit_check",
    """SELECT 'Order' AS type, 'unknown field extra' AS problem, count(*) AS n FROM orders
    UNION ALL SELECT 'Order', 'missing required field total', count(*) FROM orders
    UNION ALL SELECT 'Order', 'null status', count(*) FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def emit_check(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").alias("extra"),
    )
    static = check_emit(rows, CATALOG, "Order")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isNull()).alias("nulls"))
    problems = F.array(
        *[F.struct(F.lit(p).alias("problem"), F.col("n").alias("n")) for p in static],
        F.struct(F.lit("null status").alias("problem"), F.col("nulls").alias("n")),
    )
    return found.select(F.inline(problems)).select(F.lit("Order").alias("type"), "problem", "n")


@query(
    "snapshot_json",
    """SELECT 'Order-' || o_orderkey AS id, 'Order' AS type, o_orderkey AS key FROM orders
    UNION ALL SELECT 'Line', 'Line', l_orderkey FROM lineitem""",
)
def snapshot_json(t):
    # Positions of equal line numbers are not in the flat tables, so a line shows only its type.
    r = F.col("record")
    kind = F.get_json_object(r, "$.typeName")
    return store.snapshot_json(envelopes(t)).select(
        F.when(kind == "Order", F.get_json_object(r, "$._id")).otherwise(kind).alias("id"),
        kind.alias("type"),
        F.coalesce(
            F.get_json_object(r, "$.fields.id").cast("long"),
            F.split_part(F.get_json_object(r, "$.fields.order._ref"), F.lit("-"), F.lit(2)).try_cast("long"),
        ).alias("key"),
    )


@query(
    "snapshot_by_type",
    """SELECT 'Order' AS _type, count(*) AS records, max(c.n) AS count FROM orders, (SELECT count(*) AS n FROM orders) c
    UNION ALL SELECT 'Line', count(*), max(c.n) FROM lineitem, (SELECT count(*) AS n FROM lineitem) c""",
)
def snapshot_by_type(t):
    blocks = store.snapshot_by_type(envelopes(t))
    return blocks.groupBy("_type").agg(F.sum(F.size("records")).alias("records"), F.max("count").alias("count"))


ALIGNED = """CASE s_nationkey % 5 WHEN 0 THEN 'schema.org' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'foaf' WHEN 3 THEN 'dublin-core' ELSE 'other' END"""
IRI = """CASE s_nationkey % 5 WHEN 0 THEN 'https://schema.org/' WHEN 1 THEN 'http://www.wikidata.org/entity/'
    WHEN 2 THEN 'http://xmlns.com/foaf/0.1/' WHEN 3 THEN 'http://purl.org/dc/terms/' ELSE 'other:' END || 'N' || s_nationkey"""


def type_alignments(t: Tables) -> DataFrame:
    """A registry type's own alignment: the ontology by nation, the term its nation."""
    names = F.array(*[F.lit(x) for x in ("schema.org", "wikidata", "foaf", "dublin-core", "other")])
    return t.types.select(
        F.col("name").alias("type"),
        F.lit(0).alias("place"),
        F.get(names, (F.col("nation") % 5).cast("int")).alias("ontology"),
        F.concat(F.lit("N"), "nation").alias("term"),
        "author",
        "name",
        "version",
    )


def part_fields(t: Tables) -> DataFrame:
    """The part types a supplier delivers as the aligned fields of its registry type."""
    return (
        t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("T"), "l_suppkey").alias("type"),
            F.col("p_type").alias("field"),
            F.col("p_type").alias("place"),
            F.lit("schema.org").alias("ontology"),
            F.lower("p_type").alias("term"),
            F.col("l_suppkey").alias("key"),
            "n",
        )
    )


@query(
    "jsonld_context",
    f"""WITH f AS (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT 'T' || s_suppkey AS type, CASE WHEN s_acctbal > 0 THEN {IRI} ELSE 'T' || s_suppkey END AS id,
      p_type AS field, 'https://schema.org/' || lower(p_type) AS iri FROM supplier JOIN f ON l_suppkey = s_suppkey""",
)
def jsonld_context(t):
    positive = t.supplier.filter(F.col("s_acctbal") > 0).select(F.concat(F.lit("T"), "s_suppkey").alias("type"))
    named = type_alignments(t).join(positive, "type", "left_semi")
    made = jsonld.context(named, part_fields(t))
    return made.select("type", "id", F.explode("fields").alias("field", "iri"))


@query("alignment_iri", f"SELECT 'T' || s_suppkey AS type, {ALIGNED} AS ontology, {IRI} AS iri FROM supplier")
def alignment_iri(t):
    return type_alignments(t).select("type", "ontology", jsonld.alignment_iri(F.col("ontology"), F.col("term")).alias("iri"))


@query(
    "jsonld_graph",
    """SELECT 'Order' AS type, 'Order-' || o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total FROM orders""",
)
def jsonld_graph(t):
    nodes = jsonld.graph(envelope(order_records(t)))
    get = lambda p: F.get_json_object("node", p)
    return nodes.select(
        get("$['@type']").alias("type"), get("$._id").alias("id"), get("$.status").alias("status"),
        get("$.total").cast("double").alias("total"),
    )


@query(
    "jsonld_for_refs",
    f"""SELECT p.slug, p.supp, {ALIGNED} AS ontology FROM
      (SELECT DISTINCT l_partkey AS slug, l_suppkey AS supp, l_suppkey % 2 + 1 AS version FROM lineitem) p
      JOIN supplier ON s_suppkey = p.supp AND p.version = CASE WHEN s_acctbal > 5000 THEN 2 ELSE 1 END""",
)
def jsonld_for_refs(t):
    pins = t.lineitem.select(
        F.col("l_partkey").alias("slug"), F.col("l_suppkey").alias("supp"), (F.col("l_suppkey") % 2 + 1).alias("version")
    ).distinct()
    named = pins.join(t.types.select("author", "name", F.col("key").alias("supp")), "supp")
    return jsonld.alignments_of_pins(named, type_alignments(t)).select("slug", "supp", "ontology")
