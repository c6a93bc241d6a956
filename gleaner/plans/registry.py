"""Publishing, catalogs, type graphs and composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import diff, publishing, typegraph
from gleaner.operators.compose import Job, adapt, compose
from gleaner.operators.iterate import emit
from gleaner.plans import query
from gleaner.plans.paging import VERSIONS_SQL
from gleaner.plans.sources import CATALOG, line_records, order_records
from gleaner.plans.tables import Tables


def publish_log(t: Tables) -> DataFrame:
    """Publishes of a part in order: an event id, the content, and the base version the author worked on."""
    return t.versions.select(
        "slug",
        F.col("version").alias("seq"),
        "recipe",
        F.xxhash64("slug", "version").alias("event"),
        # Authors work on the version they last saw: often the current one, sometimes none.
        F.when(F.col("recipe") == "RF", F.lit(None).cast("long")).otherwise(F.col("input_ref")).alias("base"),
    )


@query("next_version", f"{VERSIONS_SQL} SELECT slug, version, recipe FROM v")
def next_version(t):
    rows = t.versions.select("slug", F.col("version").alias("seq"), "recipe")
    return publishing.next_version(rows, ["slug"], ["seq"]).select("slug", "version", "recipe")


@query(
    "stale_base",
    VERSIONS_SQL.replace("WITH v", "WITH RECURSIVE v", 1)
    + """, log AS (SELECT slug, version AS seq, CASE WHEN recipe = 'RF' THEN 0 ELSE input_ref END AS base FROM v),
      run AS (SELECT slug, seq, CASE WHEN base = 0 THEN 1 ELSE 0 END AS state, base = 0 AS ok FROM log WHERE seq = 1
        UNION ALL SELECT l.slug, l.seq, CASE WHEN l.base = r.state THEN r.state + 1 ELSE r.state END, l.base = r.state
        FROM run r JOIN log l ON l.slug = r.slug AND l.seq = r.seq + 1)
    SELECT slug, seq, state::BIGINT AS made_version FROM run WHERE ok""",
)
def stale_base(t):
    accepted = publishing.accepted_publishes(publish_log(t), "slug", "event", "seq", "base")
    return accepted.select("slug", "seq", "made_version")


@query(
    "dedup_pub",
    f"{VERSIONS_SQL} SELECT slug, version, sha256(recipe) AS content_hash FROM v QUALIFY recipe IS DISTINCT FROM lag(recipe) OVER (PARTITION BY slug ORDER BY version)",
)
def dedup_pub(t):
    fresh = publishing.fresh_publishes(t.versions, ["slug"], ["version"], F.col("recipe"))
    return fresh.select("slug", "version", "content_hash")


@query(
    "index_diff",
    f"""{VERSIONS_SQL}, p AS (SELECT slug, version, output_ref, lag(output_ref) OVER (PARTITION BY slug ORDER BY version) AS prior FROM v)
    SELECT slug, version, output_ref, 'add' AS change FROM p WHERE prior IS NULL OR prior <> output_ref
    UNION ALL SELECT slug, version, prior, 'remove' FROM p WHERE prior <> output_ref""",
)
def index_diff(t):
    """The whole change log of the producers' index."""
    return diff.change_log(t.versions, "slug", "version", "output_ref")


@query("index_fold", f"{VERSIONS_SQL}, n AS (SELECT * FROM v WHERE version <= 3) SELECT slug, arg_max(output_ref, version) AS output_ref FROM n GROUP BY slug")
def index_fold(t):
    """The producers' index as it was after the third version of each package, folded from its changes."""
    return diff.folded(diff.change_log(t.versions, "slug", "version", "output_ref"), "slug", "version", "output_ref", F.col("version") <= 3)


@query(
    "extends_move",
    f"""{VERSIONS_SQL}, m AS (SELECT n.slug, p.input_ref AS old, n.input_ref AS new FROM latest n LEFT JOIN v p ON p.slug = n.slug AND p.version = n.version - 1)
    SELECT slug AS child, old AS parent, 'remove' AS change FROM m WHERE old IS NOT NULL AND old <> new
    UNION ALL SELECT slug, new, 'add' FROM m WHERE old IS DISTINCT FROM new""",
)
def extends_move(t):
    """The latest publish of each child against the one before: where it leaves and where it goes."""
    head = publishing.latest(t.versions, ["slug"])
    before = head.select("slug", (F.col("version") - 1).alias("version")).join(t.versions, ["slug", "version"])
    return diff.moves(before, head, "slug", "input_ref")


@query(
    "merge_catalog",
    """SELECT 'T' || s_suppkey AS name, 'shared' AS source FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 'T' || c_custkey, 'local' FROM customer WHERE c_acctbal < 0""",
)
def merge_catalog(t):
    shared = t.types.select("name", F.lit("shared").alias("source"))
    local = t.customer.filter(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("T"), "c_custkey").alias("name"), F.lit("local").alias("source")
    )
    return diff.merge_catalog(shared, local, "name")


@query("name_collisions", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def name_collisions(t):
    return diff.name_collisions(t.part.select(F.col("p_name").alias("name")), "name")


@query("column_union", "SELECT 'k' AS field, count(*) AS n FROM events UNION ALL SELECT 'v', count(*) FROM events WHERE event_type = 'view'")
def column_union(t):
    extra = F.concat(F.rtrim("props", F.lit("}")), F.lit(', "v": 1}'))
    rows = t.events.select(F.when(F.col("event_type") == "view", extra).otherwise(F.col("props")).alias("props"))
    return diff.column_union(rows, "props")


def order_snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two overlapping snapshots: finished or open orders, then open or pending ones with urgent totals changed."""
    total = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    before = t.orders.filter("o_orderstatus in ('F', 'O')")
    after = t.orders.filter("o_orderstatus in ('O', 'P')").withColumn("o_totalprice", total)
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    return before.select(*cols), after.select(*cols)


@query(
    "snapshot_diff",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'removed' WHEN 'P' THEN 'added' ELSE 'changed' END AS change,
      CASE o_orderstatus WHEN 'O' THEN 'o_totalprice' END AS fields, 2 AS copies FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'unchanged', NULL, 2 FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'""",
)
def snapshot_diff(t):
    # Every row twice: a key that repeats is not multiplied.
    before, after = (x.unionAll(x) for x in order_snapshots(t))
    return diff.snapshot_diff(before, after, ["o_orderkey"], ["o_orderpriority", "o_totalprice"])


@query(
    "snapshot_equal",
    """SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
    UNION ALL SELECT o_orderkey, 'added' FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')""",
)
def snapshot_equal(t):
    before, after = order_snapshots(t)
    return diff.snapshot_mismatch(before, after).select("o_orderkey", "change")


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

# --- type graph -------------------------------------------------------------------------


def unregistered(t: Tables, by: int) -> DataFrame:
    """Keys that dividing suppliers' keys by `by`, again and again, leads to and that are no suppliers: `(key)`."""
    powers = ", ".join(f"{by**n}L" for n in range(1, 63) if by**n < 1 << 63)
    keys = t.supplier.select(F.explode(F.expr(f"transform(array({powers}), p -> s_suppkey div p)")).alias("key"))
    return keys.where("key > 0").distinct().join(t.types.select("key"), "key", "left_anti")


def type_nodes(t: Tables, cyclic: bool = False) -> DataFrame:
    """Types and their parents. A parent that is not registered has one all the same, so lineages do not end at it."""
    nodes = t.types.select(F.col("key").alias("type"), "parent")
    if not cyclic:
        up = F.when(F.col("key") > 1, F.floor(F.col("key") / 2))
        return nodes.unionByName(unregistered(t, 2).select(F.col("key").alias("type"), up.alias("parent")))
    last = t.types.agg(F.max("key").alias("k")).select("k").scalar()
    return nodes.withColumn("parent", F.when(F.col("type") == 1, last).otherwise(F.col("parent")))


def type_fields(t: Tables) -> DataFrame:
    """Fields of a type: the part types its supplier delivers, an Int when it delivers many of them."""
    from gleaner.plans.sources import part_fields

    return part_fields(t).select(
        F.col("key").alias("type"),
        F.array_position(F.array(*[F.lit(x) for x in PART_TYPES]), "field").alias("position"),
        "field",
        F.when(F.col("n") > 100, F.lit("Int")).otherwise(F.lit("String")).alias("kind"),
        (F.col("n") <= 50).alias("optional"),
    )


FIELDS_SQL = """f AS (SELECT l_suppkey AS type, list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) AS position, p_type AS field, CASE WHEN count(*) > 100 THEN 'Int' ELSE 'String' END AS kind, count(*) <= 50 AS optional
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type)"""
ANCESTORS_SQL = """WITH RECURSIVE a AS (SELECT s_suppkey AS type, s_suppkey AS ancestor, 0 AS depth FROM supplier
      UNION ALL SELECT type, ancestor // 2, depth + 1 FROM a WHERE ancestor > 1)"""


@query(
    "extends_flatten",
    f"""{ANCESTORS_SQL}, {FIELDS_SQL},
      j AS (SELECT a.type, f.field, arg_min(f.kind, depth) AS kind, arg_min(f.optional, depth) AS optional, arg_min(ancestor, depth) AS owner, max(depth) AS d,
        arg_max(f.position, depth) AS pos FROM a JOIN f ON f.type = a.ancestor GROUP BY 1, 2)
    SELECT type, field, kind, optional, owner, row_number() OVER (PARTITION BY type ORDER BY d DESC, pos)::INT AS place FROM j""",
)
def extends_flatten(t):
    return _registered(t, typegraph.flatten_fields(type_nodes(t), type_fields(t)))


def _registered(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(t.types.select(F.col("key").alias("type")), "type", "left_semi").select(*rows.columns)


@query(
    "extends_alignments",
    f"""{ANCESTORS_SQL} SELECT DISTINCT a.type, 'wikidata' AS ontology, 'N' || s_nationkey AS term FROM a JOIN supplier ON s_suppkey = ancestor""",
)
def extends_alignments(t):
    own = t.types.select(F.col("key").alias("type"), F.lit("wikidata").alias("ontology"), F.concat(F.lit("N"), "nation").alias("term"))
    return _registered(t, typegraph.flatten_alignments(type_nodes(t), own))


@query(
    "extends_check",
    f"""WITH RECURSIVE m AS (SELECT max(s_suppkey) AS k FROM supplier),
      e AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey = 1 THEN k ELSE s_suppkey // 2 END AS next FROM supplier, m WHERE s_suppkey > 0),
      w AS (SELECT next AS node FROM e WHERE node = 1 UNION SELECT e.next FROM w JOIN e ON e.node = w.node)
    SELECT node AS type, 'cycle' AS problem, NULL::VARCHAR AS field FROM w""",
)
def extends_check(t):
    # With key 1 extending the last key every chain ends in the cycle, so the cycle is all there is to report.
    return typegraph.extension_problems(type_nodes(t, cyclic=True), type_fields(t))


@query(
    "extends_incompatible",
    f"""{ANCESTORS_SQL}, {FIELDS_SQL},
      up AS (SELECT a.type, f.field, arg_min(f.kind, depth) AS kind, arg_min(f.optional, depth) AS optional FROM a JOIN f ON f.type = a.ancestor WHERE depth > 0 GROUP BY 1, 2)
    SELECT f.type, 'incompatible field' AS problem, f.field FROM f JOIN up ON up.type = f.type AND up.field = f.field WHERE f.kind <> up.kind OR f.optional <> up.optional""",
)
def extends_incompatible(t):
    return _registered(t, typegraph.extension_problems(type_nodes(t), type_fields(t)))


@query(
    "adapter",
    """SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS rating, 'Parent' AS kind FROM customer""",
)
def adapter(t):
    parent = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Parent").alias("kind"))
    child = T.StructType.fromDDL("id long, name string, rating double, kind string")
    return adapt(parent, child)


@query(
    "typed_refs_of",
    "SELECT s_suppkey AS type, 'T' || s_suppkey // 2 AS ref FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, 'Nation' || s_nationkey FROM supplier",
)
def typed_refs_of(t):
    kinds = t.types.select(
        F.col("key").alias("type"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("parent").isNotNull(), F.concat(F.lit("Array(Ref(T"), "parent", F.lit("))"))),
                    F.concat(F.lit("Nation"), "nation"),
                    F.lit("Array(String)"),
                )
            )
        ).alias("kind"),
    )
    return typegraph.field_type_refs(kinds, "kind").select("type", "ref")


# --- composition ------------------------------------------------------------------------


def stage_edges(t: Tables) -> DataFrame:
    """Jobs made of jobs: supplier k is made of k/2 and k/3."""
    key = F.col("s_suppkey")
    return t.supplier.filter(key > 0).select(
        key.alias("node"), F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("next")
    ).distinct()


@query(
    "stage_closure",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS node, s_suppkey // 2 AS next FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 0),
      c AS (SELECT node AS root, next AS node FROM e UNION SELECT c.root, e.next FROM c JOIN e ON e.node = c.node) SELECT root, node FROM c""",
)
def stage_closure(t):
    return typegraph.stage_closure(stage_edges(t), t.supplier.select(F.col("s_suppkey").alias("node")))


@query(
    "terminal_types",
    """WITH RECURSIVE w AS (SELECT s_suppkey AS job, s_suppkey AS node FROM supplier UNION ALL SELECT job, node // 3 FROM w WHERE node > 2) SELECT job, node AS terminal FROM w WHERE node <= 2""",
)
def terminal_types(t):
    nodes = t.supplier.select(F.col("s_suppkey").alias("node")).unionByName(unregistered(t, 3).select(F.col("key").alias("node")))
    last = nodes.where("node > 2").select("node", F.floor(F.col("node") / 3).alias("next"))
    return typegraph.terminal_stages(last, t.supplier.select(F.col("s_suppkey").alias("job")))


@query(
    "compose_cycle",
    """WITH RECURSIVE m AS (SELECT max(s_suppkey) AS k FROM supplier),
      e AS (SELECT s_suppkey AS node, s_suppkey // 2 AS next FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 0 UNION SELECT 1, k FROM m),
      c AS (SELECT node AS root, next AS node FROM e UNION SELECT c.root, e.next FROM c JOIN e ON e.node = c.node)
    SELECT a.root AS node, min(a.node) AS component FROM c a JOIN c b ON b.root = a.node AND b.node = a.root GROUP BY a.root""",
)
def compose_cycle(t):
    back = t.supplier.agg(F.max("s_suppkey").alias("next")).select(F.lit(1).cast("long").alias("node"), "next")
    return typegraph.cyclic_jobs(stage_edges(t).unionByName(back))


@query(
    "compose_check",
    f"""{VERSIONS_SQL}, s AS (SELECT l_orderkey AS chain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position, l_partkey AS job FROM lineitem),
      g AS (SELECT s.*, output_ref, input_ref FROM s JOIN latest ON latest.slug = s.job)
    SELECT a.chain, a.position, 'no input slot' AS problem FROM g a JOIN g b ON b.chain = a.chain AND b.position = a.position + 1 WHERE a.output_ref <> b.input_ref""",
)
def compose_check(t):
    from gleaner.operators.ordered import numbered
    from gleaner.plans.tables import LINE_ORDER

    stages = numbered(t.lineitem.select("l_orderkey", *LINE_ORDER), ["l_orderkey"], LINE_ORDER, "position").select(
        F.col("l_orderkey").alias("chain"), "position", F.col("l_partkey").alias("job")
    )
    text = lambda c: F.array(F.col(c).cast("string"))
    signatures = publishing.latest(t.versions, ["slug"]).select(
        F.col("slug").alias("job"), text("output_ref").alias("outputs"), text("input_ref").alias("inputs")
    )
    return typegraph.boundary_problems(stages, signatures)


def _chain(t: Tables) -> DataFrame:
    """Lines, then their revenue, then the large ones: three stages in one plan."""

    def revenue(lines):
        amount = F.col("qty") * F.col("price")
        return emit(lines, "Revenue", {"line": F.col("_id"), "part": F.col("part"), "amount": amount}, [F.xxhash64("_id")])

    def large(rows):
        return emit(
            rows.filter(F.col("amount") > 1_000_000), "Large", {"part": F.col("part"), "amount": F.col("amount")}, [F.xxhash64("_id")]
        )

    return compose(
        line_records(t),
        [
            Job(lambda lines: lines, "Line", {"qty": "double", "price": "double"}),
            Job(revenue, "Revenue", {"qty": "double", "price": "double", "part": "bigint"}),
            Job(large, "Large", {"amount": "double"}),
        ],
    )


@query("compose", "SELECT 'Large' AS type, l_partkey AS part, l_quantity * l_extendedprice AS amount FROM lineitem WHERE l_quantity * l_extendedprice > 1000000")
def compose_(t):
    return _chain(t).select(F.col("_type").alias("type"), "part", "amount")


@query("compose_adhoc", "SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_quantity * l_extendedprice > 1000000 GROUP BY 1")
def compose_adhoc(t):
    return _chain(t).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("derive_schema", "SELECT 'Order' AS type, count(*) AS n FROM orders UNION ALL SELECT 'Line', count(*) FROM lineitem")
def derive_schema(t):
    """Records cast to the schemas the catalog derives for the store, then counted."""
    from gleaner.operators.quality import bind_columns

    out = None
    for name, records in (("Order", order_records(t)), ("Line", line_records(t))):
        bound = bind_columns(records, CATALOG.schema(name))
        part = bound.filter(F.col(CATALOG.schema(name).fieldNames()[0]).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(name).alias("type"), "n")
        out = part if out is None else out.unionByName(part)
    return out
