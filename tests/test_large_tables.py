"""What larger tables and odd keys bring: small groups beside large ones, gaps between keys, narrow rows."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from gleaner.operators import diff, discovery, html, ordered, publishing
from gleaner.operators.ordered import numbered_by_size, running
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_tables(spark, tmp_path, **changed):
    """The smallest tables with some of them replaced."""
    for f in os.listdir(SF):
        if f.split(".")[0] not in changed:
            os.symlink(f"{SF}/{f}", tmp_path / f)
    for name, make in changed.items():
        make(spark.read.parquet(f"{SF}/{name}.parquet")).write.parquet(f"{tmp_path}/{name}.parquet.d")
        (part,) = [f for f in os.listdir(f"{tmp_path}/{name}.parquet.d") if f.endswith(".parquet")]
        os.symlink(f"{tmp_path}/{name}.parquet.d/{part}", tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["extends_flatten", "extends_alignments", "extends_incompatible", "terminal_types"])
def test_keys_with_gaps(spark, tmp_path, name):
    """Half of a key need not be a key: lineages go on beyond it."""
    spread = lambda c: F.when(F.col(c) % 3 == 0, F.col(c) + 1000).otherwise(F.col(c)).alias(c)
    apart = lambda c: lambda df: df.select(*[spread(c) if x == c else x for x in df.columns]).coalesce(1)
    path = with_tables(spark, tmp_path, supplier=apart("s_suppkey"), lineitem=apart("l_suppkey"))
    assert compare(driver.queries()[name](spark, path), connect(path), driver.oracle_sql()[name]) is None


def test_change_log_broadcasts_nothing(spark, monkeypatch):
    """A sorted index is small on disk and large in memory, so Spark would broadcast it."""
    rows = spark.range(100_000).select(F.floor(F.col("id") / 5).alias("k"), (F.col("id") % 5 + 1).alias("v"), (F.col("id") % 7).alias("t"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        log = diff.change_log(rows, "k", "v", "t")
        assert log.count() == 20_000 + 2 * 80_000
        assert "Broadcast" not in plan_of(log)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_change_log_of_gaps_and_nulls(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), ("a", 3, "x"), ("b", 1, "y"), ("b", 3, "y"), (None, 1, "z"), (None, 2, "w"), ("c", None, "q")]
    log = diff.change_log(spark.createDataFrame(rows, "k string, v long, t string"), "k", "v", "t")
    want = {("a", 1, "x", "add"), ("a", 2, "x", "remove"), ("a", 3, "x", "add"), ("b", 1, "y", "add"), ("b", 3, "y", "add"),
            (None, 1, "z", "add"), (None, 2, "z", "remove"), (None, 2, "w", "add"), ("c", None, "q", "add")}
    assert set(map(tuple, log.collect())) == want and log.count() == len(want)


@pytest.mark.parametrize("limit", [1, 40, 5000])
def test_numbered_by_size(spark, limit):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.nullif(F.col("id") % 101, F.lit(7)).cast("string")).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("at"))
    got = numbered_by_size(rows, ["k"], ["at"], "n", limit=limit)
    assert sorted(map(str, got.collect())) == sorted(map(str, running(rows, ["k"], ["at"], sums={"n": F.lit(1)}).collect()))


def test_small_groups_are_shuffled_once_and_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr("gleaner.session.TASK_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), "id")
    out = numbered_by_size(rows, ["k"], ["id"])
    assert plan_of(out).count("Exchange") == 1 and out.rdd.getNumPartitions() == 20


def test_small_groups_are_not_counted_one_by_one(spark, monkeypatch):
    """However many groups there are, what is shuffled to count them is bounded; a full bucket is looked into."""
    kept = []
    real = ordered.stored_counted
    monkeypatch.setattr(ordered, "BUCKETS", 64)
    monkeypatch.setattr(ordered, "stored_counted", lambda df, name="": kept.append((name, plan_of(df))) or real(df, name))
    rows = spark.range(40_000).select(F.when(F.col("id") < 5000, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    few, many = ordered.by_size(rows.where("k IS NOT NULL"), ["k"], 4000)
    assert few.count() == 35_000 and many is None
    assert [n for n, _ in kept] == ["full"]
    few, many = ordered.by_size(rows, ["k"], 4000)
    assert few.count() == 35_000 and many.count() == 5000 and many.where("k IS NOT NULL").isEmpty()
    assert [n for n, _ in kept] == ["full", "full", "large"]
    # Groups that are not large, together in one bucket, stay with the small ones.
    few, many = ordered.by_size(rows, ["k"], 5000)
    assert few.count() == 40_000 and many is None


@pytest.mark.parametrize("name", ["dq_ref", "ref_integrity"])
def test_references_are_checked_in_tasks_of_bounded_size(spark, monkeypatch, name):
    """Lines meet orders in a task for every 100 lines, and the rows are the SQL's."""
    monkeypatch.setattr("gleaner.session.TASK_ROWS", 100)
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = driver.queries()[name](spark, SF)
        assert re.search(rf"hashpartitioning\(__key#\d+, {tasks}\)", plan_of(got))
        assert compare(got, connect(SF), driver.oracle_sql()[name]) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_latest_keeps_no_row_whole(spark):
    rows = [("a", 1, "x", 5), ("a", 3, None, 6), ("a", 2, "z", 7), (None, 1, "n", 8), ("b", None, "only", 9)]
    versions = spark.createDataFrame(rows, "slug string, version long, recipe string, ref long")
    assert set(map(tuple, publishing.latest(versions, ["slug"]).collect())) == {("a", 3, None, 6), (None, 1, "n", 8), ("b", None, "only", 9)}
    assert "Sort" not in plan_of(publishing.latest(versions, ["slug"]).select("slug", "ref"))


def test_roles_shuffle_the_pins_once(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "slug long, name long")
    pins = frame((1, 5), (1, 6), (2, 5), (2, 5), (None, 5))
    got = discovery.roles(pins, frame((1, 5), (1, 5)), frame((1, 5), (2, 5)), ["slug", "name"])
    assert plan_of(got).count("Join ") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 5, "input"), (1, 5, "output"), (2, 5, "output"), (2, 5, "output")]


@pytest.mark.parametrize("limit", [1, 6, 1000])
def test_accepted_publishes_of_short_and_long_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(publishing, "REPLAYED", limit)
    log, want = [], set()
    for k in range(12):
        state = 0
        for seq in range(k):
            base = (None, 0, 1, 2, 3)[(7 * k + 3 * seq * seq) % 5]
            log.append((k, f"{k}.{seq}", seq, base))
            if (base or 0) == state:
                state += 1
                want.add((f"{k}.{seq}", state))
    frame = spark.createDataFrame(log, "k long, event string, seq long, base long")
    assert set(map(tuple, publishing.accepted_publishes(frame, "k", "event", "seq", "base").select("event", "made_version").collect())) == want


def test_captures_are_read_from_compressed_lines(spark):
    from gleaner.session import new_path
    from gleaner.sources import captures as C

    path = new_path(spark, "lines")
    C.write_captures(spark.range(50).select(F.col("id").alias("seq"), F.lit("http").alias("kind")), path)
    assert all(r["path"].endswith(".gz") for r in spark.read.format("binaryFile").load(path).select("path").collect())
    assert C.read_captures(spark, path).count() == 50


def test_runs_come_with_captures(spark):
    from gleaner.plans.sources import line_records
    from gleaner.plans.tables import Tables

    rows = line_records(Tables(spark, SF), ("run",))
    assert "Join" not in plan_of(rows) and rows.where("run IS NULL").count() == 0


def test_record_ids_move_no_fields(spark, monkeypatch):
    from gleaner.operators import iterate

    kept = []
    real = iterate.stored
    monkeypatch.setattr(iterate, "stored", lambda df, name="": kept.append(df.columns) or real(df, name))
    driver.queries()["record_id"](spark, SF)
    assert kept and "fields" not in kept[0]


def test_snapshot_counts_without_a_second_look(spark):
    from gleaner.sources.store import snapshot_by_type

    rows = spark.range(1005).select(F.when(F.col("id") % 5 == 0, "A").otherwise("B").alias("_type"), F.array(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("_order"), F.col("id").cast("string").alias("fields"))
    got = snapshot_by_type(rows, per_block=100)
    assert "Range (" not in plan_of(got)
    want = {k: [r["fields"] for r in rows.where(F.col("_type") == k).orderBy("_order").collect()] for k in "AB"}
    blocks = got.orderBy("block").collect()
    for k in "AB":
        mine = [r for r in blocks if r["_type"] == k]
        assert [x for r in mine for x in r["records"]] == want[k] and {r["count"] for r in mine} == {len(want[k])}


def test_recorded_exchanges_are_laid_by_key_before_sorting(spark, monkeypatch):
    from gleaner.operators import matching

    monkeypatch.setattr("gleaner.session.TASK_ROWS", 50)
    captures = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") >= 0, "get").otherwise("put").alias("method"), F.concat(F.lit("http://a/x?"), F.col("id") % 100).alias("url"), F.col("id").cast("string").alias("body"))
    requests = spark.range(100).select("id", F.lit("GET").alias("method"), F.concat(F.lit("http://b/x?"), "id").alias("url"))
    got = matching.replay(requests, captures)
    plan = plan_of(matching._recorded(captures, ["seq"]))
    assert "Exchange" not in plan[: plan.rindex("WindowGroupLimit")]
    assert {r["id"]: r["hit_body"] for r in got.collect()} == {i: str(i) for i in range(100)}


def test_parsed_pages_are_written_in_small_pieces():
    page = "<p>" + "<b>x</b>" * 5000 + "</p>"
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "page": [page] * 100})
    out = list(html._parsed(iter([batch]), "id"))
    assert sum(b.num_rows for b in out) == 100
    assert max(len(b"".join(b.column("page_html").to_pylist())) for b in out) <= (1 << 20) + len(page)
