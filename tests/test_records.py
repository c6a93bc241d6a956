"""Declared types, the store, quality checks, diffs, enrichment and composition."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text
from gleaner.operators import counts, diff, discovery, enrich, publishing, quality
from gleaner.operators.compose import Job, adapt, compose
from gleaner.operators.iterate import emit, envelope, for_each
from gleaner.session import new_path
from gleaner.sources import jsonld, store
from gleaner.types import Catalog, Enum, Field, RecordType, Ref, check_emit

ITEM = RecordType("Item", (Field("id", T.StringType()), Field("n", T.LongType(), optional=True, alignment="schema.org/size")), ("schema.org/Thing",))
CHILD = RecordType("Child", (Field("n", T.LongType(), optional=True), Field("of", Ref("Item"), optional=True)), ("wikidata/Q1", "schema.org/Thing"), "Item")
CATALOG = Catalog.of([ITEM, CHILD])


def test_flatten_and_schema():
    flat = CATALOG.flatten("Child")
    assert [f.name for f in flat.fields] == ["id", "n", "of"]
    assert flat.alignments == ("schema.org/Thing", "wikidata/Q1")
    schema = CATALOG.schema("Child")
    assert [f.nullable for f in schema.fields] == [False, True, False]
    assert CATALOG.output_schemas(["Item"])["Item"].fieldNames() == ["id", "n", "_id", "_scheduled_run_id", "_emitted_at"]
    assert CATALOG.schema("Item")["n"].metadata == {"alignment": "schema.org/size"}
    assert CATALOG.merged(Catalog.of([RecordType("Item", ())])).types["Item"].fields == ()


def test_flatten_survives_a_cycle():
    loop = Catalog.of([RecordType("A", (Field("a", T.LongType()),), extends="B"), RecordType("B", (Field("b", T.LongType()),), extends="A")])
    assert {f.name for f in loop.flatten("A").fields} == {"a", "b"}


def test_field_table(spark):
    rows = CATALOG.field_table(spark).filter("type = 'Child'").orderBy("position").collect()
    assert [(r["field"], r["target"]) for r in rows] == [("id", None), ("n", None), ("of", "Item")]


def test_check_emit(spark):
    df = spark.createDataFrame([(1, 1, 2)], "id int, extra int, _id int")
    assert check_emit(df, CATALOG, "Item") == ["unknown field extra", "field id is int, declared string"]
    assert check_emit(df, CATALOG, "Nope") == ["unknown type Nope"]
    assert "missing required field of" in check_emit(df, CATALOG, "Child")


def test_bind_columns(spark):
    df = spark.createDataFrame([(1.0, 2.9, True, ["a"]), (None, None, None, None)], "s double, i double, b boolean, j array<string>")
    schema = T.StructType.fromDDL("s string not null, i long, b long, j string")
    good = quality.bind_columns(df.filter("s is not null"), schema).collect()
    assert [tuple(r) for r in good] == [("1", 2, 1, '["a"]')]
    with pytest.raises(Exception):  # noqa: B017
        quality.bind_columns(df, schema).collect()
    lenient = quality.bind_columns(df, schema, strict=False).filter("_bind_error is not null").collect()
    assert [r["_bind_error"] for r in lenient] == ["s"]
    with pytest.raises(Exception):  # noqa: B017
        quality.bind_columns(spark.createDataFrame([("x",)], "i string"), T.StructType.fromDDL("i long")).collect()


def items(spark, rows):
    return emit(spark.createDataFrame(rows, "seq long, id string, n long"), "Item", {"id": F.col("id"), "n": F.col("n")}, [F.col("seq")])


def test_store_round_trip(spark):
    base = new_path(spark, "store")
    assert store.load_records(spark, base, "Item", "r1") is None
    store.write_records({"Item": items(spark, [(2, "b", None), (1, "a", 5)])}, base, "r1", 10)
    store.write_records({"Item": items(spark, [(1, "c", 7)])}, base, "007", 20)
    got = store.load_records(spark, base, "Item", "r1", limit=1).collect()
    assert [r.asDict() for r in got] == [{"_id": "Item-1", "id": "a", "n": 5}]
    assert [r["id"] for r in store.load_records(spark, base, "Item", "007").collect()] == ["c"]
    # Writing a run again replaces it.
    store.write_records({"Item": items(spark, [(1, "z", 0)])}, base, "r1", 30)
    assert [r["id"] for r in store.load_records(spark, base, "Item", "r1").collect()] == ["z"]
    snap = store.load_run_snapshot(spark, base, ["Item", "Gone"], "r1")
    assert [r["record"] for r in store.snapshot_json(snap).collect()] == ['{"_id":"Item-1","typeName":"Item","fields":{"id":"z","n":0}}']
    assert [r["node"] for r in jsonld.graph(snap).collect()] == ['{"@type":"Item","_id":"Item-1","id":"z","n":0}']


def test_uncommitted_run_is_invisible(spark):
    base = new_path(spark, "store")
    store.write_records({"Item": items(spark, [(1, "a", 5)])}, base, "r1", 10)
    for run, attempt in (("r2", "x"), ("r1", "y")):
        odd = {"_emitted_at": F.lit(1).cast("long"), "_scheduled_run_id": F.lit(run), "_attempt": F.lit(attempt)}
        rows = items(spark, [(1, "x", 5)]).withColumns(odd)
        rows.write.mode("append").partitionBy("_scheduled_run_id", "_attempt").parquet(f"{base}/Item")
    assert [r["id"] for r in store.load_records(spark, base, "Item").collect()] == ["a"]


def test_a_retried_run_leaves_nothing_behind(spark):
    base = new_path(spark, "store")
    other = items(spark, [(1, "b", 1)])
    store.write_records({"Item": items(spark, [(1, "a", 5)]), "Other": other}, base, "r1", 10)
    store.write_records({"Item": items(spark, [(2, "z", 0), (1, "y", 0)])}, base, "r1", 20)
    assert [r["id"] for r in store.load_records(spark, base, "Item", "r1").collect()] == ["y", "z"]
    assert store.load_records(spark, base, "Other", "r1").count() == 0


def test_other_columns_are_refused(spark):
    base = new_path(spark, "store")
    store.write_records({"Item": items(spark, [(1, "a", 5)])}, base, "r1", 10)
    for bad in (items(spark, [(1, "c", 7)]).withColumn("y", F.lit(1)), items(spark, [(1, "c", 7)]).drop("n"), items(spark, [(1, "c", 7)]).withColumn("n", F.lit("t"))):
        with pytest.raises(ValueError, match="differ"):
            store.write_records({"Item": bad}, base, "r2", 20)
    assert store.load_records(spark, base, "Item").count() == 1


def test_each_frame_is_computed_once(spark):
    base = new_path(spark, "store")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = items(spark, [(i, str(i), i) for i in range(20)])
    rows = rows.mapInArrow(count, rows.schema).withColumn("run", (F.col("n") % 3).cast("string"))
    store.write_records({"Item": rows.coalesce(1)}, base, F.col("run"), 10)
    assert seen.value == 20
    assert store.load_records(spark, base, "Item").count() == 20


def test_snapshot_blocks(spark):
    env = envelope(items(spark, [(i, str(i), i) for i in range(25)]))
    got = store.snapshot_by_type(env, per_block=10).orderBy("block").collect()
    assert [(r["block"], len(r["records"]), r["count"]) for r in got] == [(0, 10, 25), (1, 10, 25), (2, 5, 25)]
    assert got[1]["records"][0] == '{"id":"10","n":10}'


def test_jsonld_context(spark):
    types = spark.createDataFrame([("A", 0, "schema.org", "Thing"), ("A", 1, "foaf", "X")], "type string, place int, ontology string, term string")
    fields = spark.createDataFrame([("A", 0, "n", "wikidata", "P1"), ("B", 0, "m", "mine", "t")], "type string, place int, field string, ontology string, term string")
    got = {r["type"]: (r["id"], r["fields"]) for r in jsonld.context(types, fields).collect()}
    assert got == {"A": ("https://schema.org/Thing", {"n": "http://www.wikidata.org/entity/P1"}), "B": ("B", {"m": "mine:t"})}


def test_golden_user_functions(spark):
    docs = spark.createDataFrame([(1, '{"items":[{"id":"1","label":"calm"},{"id":"2","label":"vivid"}]}')], "seq long, body string")
    loud = lambda c: text.upper(c)
    rows = for_each(docs.select("seq", F.from_json("body", "items array<struct<id:string,label:string>>")["items"].alias("i")), F.col("i"), "it", at="at")
    out = emit(rows, "Item", {"id": F.col("it.id"), "label": loud(F.col("it.label"))}, [F.col("seq"), F.col("at")])
    assert [(r["id"], r["label"]) for r in out.orderBy("_order").collect()] == [("1", "CALM"), ("2", "VIVID")]


def snak(kind, value, snaktype="value"):
    return {"mainsnak": {"snaktype": snaktype, "datatype": kind, "datavalue": {"value": value}}}


def test_golden_entities(spark):
    import json

    claims = {
        "P112": [snak("wikibase-item", {"id": "Q5"}), snak("wikibase-item", {"id": "Q6"})],
        "P571": [snak("time", {"time": "+2010-01-01T00:00:00Z"})],
        "P1128": [snak("quantity", {"amount": "+8100"})],
        "P1": [snak("string", "x", "novalue")],
        "P2": [snak("monolingualtext", {"text": "hi", "language": "en"})],
        "P3": [snak("globe-coordinate", {"latitude": 1.5, "longitude": -2})],
        "P4": [snak("external-id", "ext")],
        "P5": [],
    }
    bodies = [
        json.dumps({"entities": {"Q1": {"labels": {"en": {"value": "Stripe"}}, "claims": claims}}}),
        json.dumps({"entities": {"Q2": {"missing": ""}}}),
    ]
    caps = spark.createDataFrame([(b,) for b in bodies], "body string")
    table = enrich.entities(enrich.from_responses(caps), "key", "json")
    people = spark.createDataFrame([("c1", "Q1"), ("c2", "Q2"), ("c3", "Q3"), ("c4", None)], "id string, q string")
    wanted = {p: p for p in claims} | {"gone": "P9"}
    got = {r["id"]: r for r in enrich.enrich(people, "q", table, wanted).collect()}
    assert [got["c1"][p] for p in ("P112", "P571", "P1128", "P1", "P2", "P3", "P4", "P5", "gone", "entity_label")] == [
        "Q5", "+2010-01-01T00:00:00Z", "+8100", None, "hi", "1.5,-2", "ext", None, None, "Stripe",
    ]
    assert [got[c]["enrich_error"] for c in ("c1", "c2", "c3", "c4")] == [None, "entity is missing", "entity not present", "key is null"]
    with pytest.raises(Exception):  # noqa: B017
        enrich.enrich(people, "q", table, wanted, strict=True).collect()


def test_compose(spark):
    start = items(spark, [(1, "a", 5), (2, "b", 6)])
    big = Job(lambda d: emit(d.filter("n > 5"), "Big", {"n": F.col("n")}, [F.col("n")]), "Big", {"n": "bigint"})
    assert [r["n"] for r in compose(start, [Job(lambda d: d, "Item"), big]).collect()] == [6]
    with pytest.raises(ValueError):
        compose(start, [big, Job(lambda d: d, "X", {"id": "string"})])
    child = adapt(spark.createDataFrame([("a", 1)], "id string, n int"), T.StructType.fromDDL("id string, n long, more double"))
    assert [tuple(r) for r in child.collect()] == [("a", 1, None)]


def test_expectations(spark):
    df = spark.createDataFrame([("A",)] * 3 + [("B",)], "_type string")
    got = counts.check_counts(df, [("A", ">=", 3), ("A", "<", 3), ("B", "!=", 1), ("C", "==", 0), ("C", ">", 0), ("A", "<=", 2)])
    assert [(r["type"], r["op"], r["actual"], r["met"]) for r in got.collect()] == [
        ("A", ">=", 3, True), ("A", "<", 3, False), ("B", "!=", 1, False), ("C", "==", 0, True), ("C", ">", 0, False), ("A", "<=", 3, False),
    ]


def test_snapshot_comparison(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 1)], "k int, s string, n int")
    got = sorted(tuple(r) for r in diff.snapshot_diff(a, b, ["k"], ["s", "n"]).collect())
    assert got == [(1, "unchanged", None, 1), (2, "changed", "n", 1), (3, "removed", None, 1), (4, "added", None, 1)]
    assert diff.snapshot_equal(a, a.orderBy("k")) and not diff.snapshot_equal(a, b)
    assert not diff.snapshot_equal(a, a.unionByName(a.limit(1)))


def test_repeated_and_null_keys_are_not_multiplied(spark):
    a = spark.createDataFrame([(1, "x")] * 3 + [(None, "n"), (2, "p"), (2, "q"), (2, "q")], "k int, s string")
    b = spark.createDataFrame([(1, "x")] * 3 + [(None, "n"), (2, "q"), (2, "r"), (2, "t"), (2, "u")], "k int, s string")
    assert sorted(map(str, diff.snapshot_diff(a, a, ["k"], ["s"]).select("k", "change", "copies").toLocalIterator())) == sorted(
        [f"Row(k={k}, change='unchanged', copies={n})" for k, n in ((1, 3), (None, 1), (2, 3))]
    )
    got = {(r["k"], r["change"], r["fields"]): r["copies"] for r in diff.snapshot_diff(a, b, ["k"], ["s"]).collect()}
    assert got == {(1, "unchanged", None): 3, (None, "unchanged", None): 1, (2, "unchanged", None): 1, (2, "changed", "s"): 2, (2, "added", None): 1}


def test_golden_is_written_kept_and_compared(spark):
    path = new_path(spark, "golden")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, s string")
    assert diff.golden(spark, path, a)[0] == "written"
    assert diff.golden(spark, path, a)[0] == "equal"
    state, rows = diff.golden(spark, path, b)
    assert state == "different" and sorted((r["k"], r["change"]) for r in rows.collect()) == [(2, "added"), (2, "removed")]
    assert diff.golden(spark, path, a)[0] == "equal"
    assert diff.golden(spark, path, b, update=True)[0] == "written" and diff.golden(spark, path, b)[0] == "equal"


def test_moved_children(spark):
    a = spark.createDataFrame([("c1", "p"), ("c2", "p"), ("c3", None), ("c4", "q")], "c string, p string")
    b = spark.createDataFrame([("c1", "p"), ("c2", "q"), ("c3", "q"), ("c5", "p")], "c string, p string")
    got = sorted(tuple(r) for r in diff.moves(a, b, "c", "p").collect())
    assert got == [("c2", "p", "remove"), ("c2", "q", "add"), ("c3", "q", "add"), ("c4", "q", "remove"), ("c5", "p", "add")]


def test_publish_log_against_replay(spark):
    import random

    r = random.Random(11)
    log = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.choice([None, 0, 1, 1, 2, 2, 3, 4, 5])) for i in range(400)]
    df = spark.createDataFrame([(k, i + 1000, i, b) for k, i, b in log], "key string, ev long, seq long, base long")
    got = {(x["key"], x["seq"]): x["made_version"] for x in publishing.accepted_publishes(df, "key", "ev", "seq", "base").collect()}
    state, want = {}, {}
    for k, i, b in log:
        if (b or 0) == state.get(k, 0):
            state[k] = state.get(k, 0) + 1
            want[(k, i)] = state[k]
    assert got == want


def test_fresh_publishes(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate("xxyyx")] + [("b", 0, "x")], "k string, at int, src string")
    got = sorted((r["k"], r["at"]) for r in publishing.fresh_publishes(df, ["k"], ["at"], F.col("src")).collect())
    assert got == [("a", 0), ("a", 2), ("a", 4), ("b", 0)]


def test_stars_are_idempotent(spark):
    df = spark.createDataFrame(
        [("u", "p", 1, True), ("u", "p", 2, True), ("v", "p", 3, True), ("v", "p", 4, False), ("v", "p", 5, False), ("w", "q", 6, False)],
        "user string, package string, at int, added boolean",
    )
    stars = publishing.star_state(df, "user", "package", ["at"], F.col("added"))
    assert [tuple(r) for r in publishing.star_counts(stars, "package").collect()] == [("p", 1)]


def test_keyset_pages_cover_everything(spark):
    rows = spark.createDataFrame([(i, i % 4) for i in range(23)], "ref int, stars int").cache()
    seen, cursor = [], None
    while True:
        page, nxt = discovery.keyset_page(rows, "stars", "ref", cursor, 5)
        seen += [(r["stars"], r["ref"]) for r in page.collect()]
        nxt = nxt.collect()
        if not nxt:
            break
        cursor = (nxt[0]["stars"], nxt[0]["ref"])
    assert seen == sorted(((i % 4, i) for i in range(23)), key=lambda x: (-x[0], x[1]))
    assert discovery.keyset_page(rows, "stars", "ref", (99, 99), 5)[0].count() == 5
    with pytest.raises(ValueError):
        discovery.sort_packages(rows, "size", "ref")


def test_type_refs_and_enum(spark):
    refs = spark.createDataFrame(
        [("o", "acme", "T", 1), ("o", "acme", "T", 2), ("o", "Acme", "T", 1), ("p", "acme", "t", 1), ("p", "acme", "T", 0), ("p", None, "T", 1)],
        "owner string, author string, name string, version int",
    )
    got = sorted((str(r["owner"]), str(r["author"]), r["name"], r["problem"]) for r in quality.type_ref_problems(refs, "owner", "author", "name", "version").collect())
    assert got == [("o", "Acme", "T", "author"), ("o", "acme", "T", "duplicate"), ("p", "None", "T", "author"), ("p", "acme", "T", "version"), ("p", "acme", "t", "name")]
    assert Field("e", Enum("E", ("a",))).spark_type() == T.StringType()
