import pytest
from pyspark.sql import functions as F

from gleaner.operators import matching, paginate, requests
from gleaner.operators.iterate import emit, envelope, for_each, ref, with_record_ids
from gleaner.operators.refs import bind_single, dangling, resolve
from gleaner.session import new_path
from gleaner.sources import captures as C


def test_missing_file_is_empty(spark):
    assert C.read_captures(spark, "/tmp/spark-no-such-folder/x").count() == 0


def test_bad_line_fails_or_is_set_aside(spark):
    path = new_path(spark, "jsonl")
    lines = ['{"kind":"http","url":"u","method":"GET","status":200,"body":"b"}', "  ", '{"kind": "http", ']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):  # noqa: B017
        C.read_captures(spark, path).collect()
    good, bad = C.quarantine(C.read_captures(spark, path, strict=False))
    assert [r["url"] for r in good.collect()] == ["u"]
    assert [r["line"] for r in bad.collect()] == [lines[2]]


@pytest.mark.parametrize(
    "headers,body,want",
    [
        ({"content-type": "application/json; charset=x"}, '{"a":1}', ("json", '{"a":1}', None)),
        ({"Content-Type": "application/json"}, "{broken", ("json", None, "{broken")),
        ({"Content-Type": "text/plain"}, '{"a":1}', ("text", None, '{"a":1}')),
        ({"CONTENT-TYPE": "Text/HTML"}, "<p>", ("html", None, "<p>")),
        ({"Content-Type": "application/ld+json"}, "[1]", ("json", "[1]", None)),
        ({"Content-Type": "application/atom+xml"}, "<a/>", ("xml", None, "<a/>")),
        ({"Content-Type": " ; x"}, '{"a":1}', ("json", '{"a":1}', None)),
        ({}, '{"a":1}', ("json", '{"a":1}', None)),
        ({}, "plain", ("text", None, "plain")),
        ({}, "", ("text", None, None)),
    ],
)
def test_decode_body(spark, headers, body, want):
    df = spark.createDataFrame([(headers, body)], "h map<string,string>, b string")
    got = df.select(C.decode_body(F.col("h"), F.col("b")).alias("d")).select("d.format", F.to_json("d.value").alias("v"), "d.text").first()
    assert tuple(got) == want


def test_decode_override(spark):
    df = spark.createDataFrame([({"Content-Type": "text/plain"}, "[1]")], "h map<string,string>, b string")
    d = df.select(C.decode_body(F.col("h"), F.col("b"), "json").alias("d")).select("d.format", F.to_json("d.value")).first()
    assert tuple(d) == ("json", "[1]")


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://h/a/b?y=2&x=1", "/a/b?x=1&y=2"),
        ("http://other/a/b?x=1&y=2", "/a/b?x=1&y=2"),
        ("/a/b", "/a/b"),
        ("https://h", "h"),
        ("https://h/a//b/c", "/c"),
        ("https://h/a?", "/a?"),
        ("https://h/a?x=1#top", "/a?x=1#top"),
    ],
)
def test_url_key(spark, url, key):
    assert spark.range(1).select(matching.url_key(F.lit(url)).alias("k")).first()["k"] == key


def test_replay_takes_the_first_exchange(spark):
    caps = spark.createDataFrame(
        [(2, "https://a/x?p=1", "GET", 200, "second"), (1, "https://b/x?p=1", "get", 200, "first"), (3, "https://a/y", "POST", 200, "p")],
        "seq long, url string, method string, status int, body string",
    )
    reqs = spark.createDataFrame([(1, "GET", "http://z/x?p=1"), (2, "GET", "http://z/y")], "id int, method string, url string")
    got = {r["id"]: r["hit_body"] for r in matching.replay(reqs, caps).collect()}
    assert got == {1: "first", 2: None}
    assert [r["id"] for r in matching.replay_misses(reqs, caps).collect()] == [2]


def test_rules(spark):
    caps = spark.createDataFrame([(1, "https://a/en/x.html"), (2, "https://a/fr/")], "seq long, url string")
    rules = [("en", "/en/"), ("html", r"\.html$"), ("never", "zzz")]
    got = sorted((r["rule_no"], r["seq"]) for r in matching.match_rules(caps, rules).collect())
    assert got == [(0, 1), (1, 1)]
    assert [r["seq"] for r in matching.unmatched_captures(caps, rules).collect()] == [2]
    assert [r["rule"] for r in matching.unfired_rules(caps, rules).collect()] == ["never"]
    assert [r["rule"] for r in matching.unfired_rules(caps.limit(0), rules).collect()] == ["en", "html", "never"]


def test_loops_refs_and_ids(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["c"])], "seq long, items array<string>")
    parents = emit(docs, "P", {"n": F.col("seq")}, [F.col("seq")])
    kids = for_each(docs.withColumn("up", ref("P", [F.col("seq")])), F.col("items"), "x", at="i")
    kids = emit(kids, "K", {"x": F.col("x"), "up": F.col("up")}, [F.col("seq"), F.col("i")])
    both = with_record_ids(envelope(parents).unionByName(envelope(kids)), blocks=3)
    got = [(r["rec_id"], r["_id"]) for r in both.orderBy("_order").collect()]
    assert got == [("rec-0", "P-1"), ("rec-1", "K-1.0"), ("rec-2", "K-1.1"), ("rec-3", "P-2"), ("rec-4", "P-3"), ("rec-5", "K-3.0")]
    assert sorted((r["x"], r["parent_n"]) for r in resolve(kids, "up", parents).collect()) == [("a", 1), ("b", 1), ("c", 3)]
    assert [r["x"] for r in dangling(kids, "up", parents.filter("n = 1"), "P").collect()] == ["c"]
    sample = for_each(docs, F.col("items"), "x", sample=1)
    assert sorted(r["x"] for r in sample.collect()) == ["a", "c"]


def test_bind_single(spark):
    df = spark.range(2)
    one = spark.createDataFrame([(7,)], "v int")
    assert [r["p"]["v"] for r in bind_single(df, one, "p").collect()] == [7, 7]
    assert [r["p"] for r in bind_single(df, one.limit(0), "p").collect()] == [None, None]
    with pytest.raises(Exception):  # noqa: B017
        bind_single(df, spark.range(2).toDF("v"), "p").collect()


def pages(spark, rows):
    return spark.createDataFrame(rows, "source string, page int, items array<string>, total int, next string")


def test_pages_with_total(spark):
    got = paginate.pages_with_total(
        pages(spark, [("s", 1, ["a", "b"], 4, None), ("s", 2, ["c", "d"], 4, None), ("s", 3, ["e"], 4, None), ("t", 1, [], 9, None), ("t", 2, ["x"], 9, None)]),
        "source", "page", F.size("items"), F.col("total"), blocks=3,
    )
    items = paginate.page_items(got, F.col("items")).orderBy("source", "page", "position").collect()
    assert [r["item"] for r in items] == ["a", "b", "c", "d"]


def test_pages_with_total_of_a_hot_source(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        "id",
        F.lit(2).alias("n"),
        F.when(F.col("id") < 4000, F.lit(5001)).otherwise(F.lit(7)).alias("total"),
    )
    got = paginate.pages_with_total(rows, "source", "id", F.col("n"), F.col("total"), blocks=16).groupBy("source").count()
    want = {"hot": 2501, **{f"s{i}": 4 for i in range(50)}}
    assert {r["source"]: r["count"] for r in got.collect()} == want


def test_cursor(spark):
    p = pages(spark, [("s", 1, ["a"], 0, "k2"), ("s", 2, ["b"], 0, "k3"), ("s", 3, ["c"], 0, ""), ("s", 9, ["z"], 0, "k1")]).withColumn(
        "token", F.concat(F.lit("k"), "page")
    )
    starts = spark.createDataFrame([("s", "k1")], "source string, token string")
    got = paginate.pages_by_cursor(p, starts, p.columns[0], "token", F.col("next")).orderBy("hops").collect()
    assert [(r["hops"], r["items"][0]) for r in got] == [(0, "a"), (1, "b"), (2, "c")]


def test_tokens_belong_to_their_source(spark):
    rows = [("A", "1", "2"), ("A", "2", "3"), ("A", "3", None), ("B", "1", "2"), ("B", "2", ""), ("C", "1", "1")]
    p = spark.createDataFrame(rows, "src string, token string, next string")
    starts = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "1")], "src string, token string")
    got = paginate.pages_by_cursor(p, starts, "src", "token", F.col("next")).select("src", "token", "hops").collect()
    assert sorted(tuple(r) for r in got) == [("A", "1", 0), ("A", "2", 1), ("A", "3", 2), ("B", "1", 0), ("B", "2", 1), ("C", "1", 0)]
    # A token that is no text ends the walk.
    numbers = p.withColumn("next", F.col("next").try_cast("long"))
    assert paginate.pages_by_cursor(numbers, starts, "src", "token", F.col("next")).count() == 3


def test_request_cap(spark):
    r = spark.range(1205).select((F.col("id") % 2).alias("run"), "id")
    got = paginate.request_cap(r, "run", ["id"], 602).groupBy("run", "over_cap", "capped").count().orderBy("run", "over_cap").collect()
    assert [tuple(x) for x in got] == [(0, False, True, 602), (0, True, True, 1), (1, False, False, 602)]
    with pytest.raises(Exception, match="exceeded 602"):
        paginate.request_cap(r, "run", ["id"], 602, strict=True).collect()


def test_request_bodies(spark):
    one = spark.createDataFrame([("a b&c", 2)], "q string, n int")
    got = one.select(
        requests.form_body({"q": F.col("q"), "n": F.col("n")}).alias("form"),
        requests.json_body({"q": F.col("q"), "in": F.struct(F.col("n").alias("x")), "z": F.lit(None).cast("string")}).alias("json"),
        requests.with_query(F.lit("http://h/p?x=1"), {"page": F.col("n")}).alias("url"),
        requests.headers({"A": F.col("q")}, "agent", "text/plain").alias("h"),
    ).first()
    assert got["form"] == "q=a+b%26c&n=2"
    assert got["json"] == '{"q":"a b&c","in":{"x":2},"z":null}'
    assert got["url"] == "http://h/p?x=1&page=2"
    assert got["h"] == {"A": "a b&c", "User-Agent": "agent", "Content-Type": "text/plain"}


def test_inputs(spark):
    from gleaner.sources import inputs

    def file(text):
        path = new_path(spark, "inputs")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return path

    path = file('{"site": "x", "limit": 5, "items": [{"id": 1}, {"id": 2}]}')
    given = inputs.read_inputs(spark, path)
    assert given["site"] == "x" and set(inputs.constants(given)) == {"site", "limit"}
    assert [r["id"] for r in inputs.table(spark, path, "items", "id: int").collect()] == [1, 2]
    with pytest.raises(ValueError):
        inputs.read_inputs(spark, file("[1]"))
