"""Fences, as-of joins, change logs, line numbers and reports, against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import diff, discovery, html
from gleaner.operators.ordered import as_of
from gleaner.operators.selectors import select
from gleaner.session import new_path
from gleaner.sources import captures as C


def test_pages_of_every_owner_follow_one_another(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i) for i in rng.sample(range(10_000), 800)] + [("one", 5)]
    pages = discovery.paged(spark.createDataFrame(rows, "who string, at long").repartition(5), "who", "at", 7)
    for who in ("hot", "a", "one"):
        want, got, cursor = sorted(a for w, a in rows if w == who), [], None
        page = [r["at"] for r in pages.page(who, 0).collect()]
        while page:
            got += sorted(page)
            assert len(page) == 7 or len(got) == len(want)
            cursor = max(page)
            page = [r["at"] for r in pages.after(who, cursor).collect()] if len(got) < 60 else sorted(want)[len(got) :]
        assert got == want
    last = {(r["owner"], r["page"]) for r in pages.fences.where("NOT more").collect()}
    assert last == {(w, (sum(x == w for x, _ in rows) - 1) // 7) for w in {w for w, _ in rows}}
    assert pages.page("nobody", 0).count() == 0 and pages.page("one", 1).count() == 0 and pages.after("one", 5).count() == 0


def test_as_of_with_ties_and_a_hot_key(spark):
    rng = random.Random(2)
    deployed = [(rng.choice(["hot", "a", "b", None]), rng.choice([None, *range(40)]), v) for v in range(150)]
    runs = [(rng.choice(["hot", "hot", "a", "c", None]), rng.choice([None, *range(-3, 45)]), i) for i in range(400)]
    got = as_of(
        spark.createDataFrame(runs, "job string, at long, id long").repartition(3), spark.createDataFrame(deployed, "job string, at long, v long"),
        "job", "at", ["v"], ["id"], ["v"], blocks=6,
    )
    assert got.columns == ["job", "at", "id", "v"] and got.count() == len(runs)
    for r in got.collect():
        mine = sorted((a, v) for j, a, v in deployed if j == r["job"] and a is not None)
        k = bisect.bisect_right(mine, (r["at"], float("inf"))) if r["at"] is not None else 0
        assert r["v"] == (mine[k - 1][1] if k else None), r


def test_folding_the_whole_log_gives_the_last_index(spark):
    rng = random.Random(3)
    rows = [(k, v, t) for k in "abc" for v in range(1, 6) for t in rng.sample("wxyz", rng.randint(0, 3))] + [("d", 1, None), ("d", 2, "x"), ("a", 1, "w"), ("a", 1, "w")]
    frame = spark.createDataFrame(rows, "slug string, version long, term string")
    log = diff.change_log(frame, "slug", "version", "term").cache()
    at = lambda n: sorted({(k, t) for k, v, t in rows if t and v == min(n, max(x for y, x, _ in rows if y == k))})
    present = {(k, v) for k, v, _ in rows}
    for n in range(1, 6):
        got = sorted(map(tuple, diff.folded(log, "slug", "version", "term", F.col("version") <= n).collect()))
        if all((k, min(n, 2 if k == "d" else 5)) in present for k in "abcd"):
            assert got == at(n)
    for r in log.collect():
        before, now = ((r["slug"], r["version"] + d, r["term"]) in rows for d in (-1, 0))
        assert (before, now) == ((False, True) if r["change"] == "add" else (True, False))


def test_bad_lines_of_files_in_several_splits(spark):
    path = new_path(spark, "lines")
    rng = random.Random(4)
    files, want = {}, set()
    for f in range(3):
        lines = []
        for i in range(2000):
            kind = rng.random()
            lines.append("" if kind < 0.1 else '{"kind": "ht' if kind < 0.15 else '{"kind": "http", "seq": 1, "body": "' + "x" * rng.randint(0, 60) + '"}')
            if lines[-1].endswith("ht"):
                want.add((f, i + 1, lines[-1]))
        files[f] = lines
        spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(f"{path}/file={f}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert C.placed_lines(spark, path).select("file", "block").distinct().count() > 6
        got = C.bad_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(int(r["file"].split("file=")[1][0]), r["line"], r["value"]) for r in got} == want and len(got) == len(want)
    assert C.bad_lines(spark, f"{path}/none").count() == 0


def test_commas_in_selectors_and_pages_without_html(spark):
    pages = spark.createDataFrame([(1, '<a title="x,y">1</a><a title="z">2</a><b>3</b>'), (2, None), (3, "")], "id int, html string")
    parsed = html.parse_pages(pages, "id", "html")
    assert parsed.count() == 3
    text = lambda s: html.list_text(F.col("page_text"), select(F.col("nodes"), s))
    got = {r["id"]: tuple(r)[1:] for r in parsed.select("id", text('a[title="x,y"]'), text('a[title="x,y"], b')).collect()}
    assert got[1] == ("1", "1 3") and got[2] == (None, None)
    for bad in ("a,", ",a", "a,,b", ""):
        with pytest.raises(ValueError):
            select(F.col("nodes"), bad)


def test_lookups_read_the_ranges_they_need(spark):
    from gleaner.sources import lookup

    path = new_path(spark, "lookup")
    rows = [(k, f"v{k}") for k in [*range(-30, 60, 3), 1000]]
    lookup.write_lookup(spark.createDataFrame([*rows, (None, "lost")], "key int, value string"), "key", path, 10)
    table = lambda: lookup.read_lookup(spark, path, "key", 10, "key long, value string")
    tests = {
        "key = 21": lambda k: k == 21,
        "key IN (0, 21, 1000, 7)": lambda k: k in (0, 21, 1000, 7),
        "key >= -5 AND key < 30 AND value <> 'v3'": lambda k: -5 <= k < 30 and k != 3,
        "key > 57 AND key <= 1000": lambda k: 57 < k <= 1000,
        "key = 3 OR key = 60": lambda k: k in (3, 60),
        "value = 'v6'": lambda k: k == 6,
        "key IS NULL": lambda k: False,
    }
    for sql, test in tests.items():
        assert sorted(map(tuple, table().where(sql).collect())) == [r for r in rows if test(r[0])], sql
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringContains

    reader = lookup.LookupReader(path, "key", 10, table().schema)
    other = StringContains(("value",), "x")
    assert list(reader.pushFilters([GreaterThan(("key",), -1), LessThan(("key",), 25), other])) == [other]
    assert [p.folder.rsplit("=", 1)[1] for p in reader.partitions()] == ["0", "1", "2"]
    assert list(reader.pushFilters([In(("key",), (21, 24, None)), EqualTo(("key",), 21)])) == []
    assert len(reader.partitions()) == 1 and sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 1
    asked = spark.createDataFrame([(3,), (18,), (None,)], "k long")
    assert sorted(r["key"] for r in lookup.needed(table(), "key", asked, "k").collect()) == [3, 6, 9, 12, 15, 18]
    assert lookup.needed(table(), "key", asked.where("k > 99"), "k").count() == 0
    plan = table().where("key = 21 AND value = 'v21'")._jdf.queryExecution().executedPlan().toString()
    assert "= v21" in plan and "= 21" not in plan  # the test of the key is the source's
