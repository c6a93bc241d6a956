"""Streams with state: late and early arrivals, retries and restarts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.session import new_path
from gleaner.streaming import captures as S
from gleaner.streaming import keyed

MINUTE = 60_000_000
START = 1_700_000_000_000_000


def wave(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/wave={k}")


def stretches(times, quiet):
    out = []
    for t in sorted(times):
        if out and t - out[-1][-1] <= quiet:
            out[-1].append(t)
        else:
            out.append([t])
    return [(s[0], s[-1], len(s)) for s in out]


def test_every_capture_is_in_a_stretch_or_late(spark):
    rng = random.Random(1)
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    schema, sources = "source string, at_us long", ["a", "b", None, "busy"]
    waves = []
    for k in range(3):
        base = START + k * 600 * MINUTE
        waves.append([(rng.choice(sources), base + rng.randrange(500 * MINUTE)) for _ in range(60)] + [("busy", base + i * 1000) for i in range(3000)])
    late = [("a", START + 3 * MINUTE), ("late only", START), (None, START + 5 * MINUTE), ("a", None)]
    waves[2] += late
    for k, rows in enumerate(waves):
        wave(spark, folder, k, rows, schema)
        stream = S.read_stream(spark, f"{folder}/wave=*", schema).withColumn("at", F.timestamp_micros("at_us"))
        S.drain(keyed.settle(stream, "source", "at", 60 * MINUTE), out=out, state=state)
    done = keyed.settled(spark, out, state)
    got = sorted((str(r["source"]), r["first"], r["last"], r["n"]) for r in done.stretches.collect())
    want = []
    for s in sources:
        mine = [t for rows in waves for x, t in rows if x == s and (x, t) not in late]
        want += [(str(s), *x) for x in stretches(mine, 60 * MINUTE)]
    assert got == sorted(want)
    assert Counter(r["source"] for r in done.late.collect()) == Counter(s for s, _ in late)
    total = sum(r["n"] for r in done.stretches.collect()) + sum(r["n"] for r in done.late.collect())
    assert total == sum(map(len, waves))
    assert {r["closed"] for r in done.stretches.collect()} == {True, False}


def test_pages_wait_for_the_ones_before_them(spark):
    rng = random.Random(2)
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    schema = "source long, page long, n_items long, total long"
    pages, want = [], []
    for s in [None, *range(30)]:
        n, total = rng.randint(1, 9), rng.choice([None, 5, 10, 1000])
        items = [rng.choice([0, 1, 3, 3, 3, None]) for _ in range(n)]
        gap = rng.choice([None, rng.randint(1, n)])
        mine = [(s, i + 1, x, total) for i, x in enumerate(items) if i + 1 != gap]
        pages += mine
        had, at = 0, 1
        by = {p[1]: p[2] for p in mine}
        while at in by:
            want.append((s, at))
            had += by[at] or 0
            if not by[at] or (total is not None and had >= total):
                break
            at += 1
    pages += rng.choices(pages, k=20) + [(1, None, 3, 9)]
    rng.shuffle(pages)
    for k in range(4):
        wave(spark, folder, k, pages[k::4], schema)
        S.drain(keyed.pages(S.read_stream(spark, f"{folder}/wave=*", schema), "source", "page", "n_items", "total"), out=out, state=state)
    got = [(r["source"], r["page"]) for r in spark.read.parquet(out).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    waiting = keyed.state_rows(spark, state, "early").count()
    assert waiting < len(pages)


def test_arrival_numbers_are_gapless_and_the_same_after_a_retry(spark):
    folder, out, counts, state = (new_path(spark, n) for n in ("in", "out", "counts", "state"))
    schema, write = "seq long, pad string", S.number_arrivals(out, counts)
    batches = {}

    def twice(batch, batch_id):
        write(batch, batch_id)
        first = sorted(map(tuple, spark.read.parquet(f"{out}/batch={batch_id}").collect()))
        write(batch, batch_id)
        assert sorted(map(tuple, spark.read.parquet(f"{out}/batch={batch_id}").collect())) == first
        batches[batch_id] = first

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # several splits of a file
    try:
        for k in range(3):
            wave(spark, folder, k, [(k * 1000 + i, "x" * 50) for i in range(700)], schema)
            S.drain(S.placed(S.read_stream(spark, f"{folder}/wave=*", schema)), each=twice, state=state)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = sorted((r["arrival"], r["seq"]) for r in spark.read.parquet(out).collect())
    assert [a for a, _ in rows] == list(range(1, 2101)) and [s for _, s in rows] == [k * 1000 + i for k in range(3) for i in range(700)]
    assert len(batches) == 3


def test_seen_keys_last_over_batches_and_retries(spark):
    seen, out = new_path(spark, "seen"), new_path(spark, "once")
    write = S.first_seen(["a", "b"], seen, out)
    make = lambda rows: spark.createDataFrame(rows, "a string, b string, n int")
    batches = [[("x", "y", 1), ("x", "y", 2), (None, "y", 3), ("y", None, 4)], [("x", "y", 5), ("y", None, 6), ("z", "", 7)], [], [("z", "", 8), (None, None, 9)]]
    for k, rows in enumerate(batches):
        write(make(rows), k)
        write(make(rows), k)
    got = [(r["a"], r["b"]) for r in spark.read.parquet(out).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("x", "y"), (None, "y"), ("y", None), ("z", ""), (None, None)]))


def test_expectations_of_each_run(spark):
    folder = new_path(spark, "in")
    for k in range(3):
        wave(spark, folder, k, [("a", 1), ("a", 2), ("b", 1), (None, 2)], "type string, run int")
    listener = S.Expectations([("a", "==", 3), ("b", ">", 0), ("c", "<", 1)])
    spark.streams.addListener(listener)
    try:
        for run in (1, 2, 3):
            rows = S.read_stream(spark, f"{folder}/wave=*", "type string, run int", per_batch=1).where(F.col("run") == run)
            listener.run(listener.watched(rows, "type"), f"run {run}", new_path(spark, "state"), new_path(spark, "out"))
    finally:
        spark.streams.removeListener(listener)
    got = sorted((r["run"], r["type"], r["actual"]) for r in listener.unmet(spark).collect())
    assert got == [("run 2", "b", 0), ("run 3", "a", 0), ("run 3", "b", 0)]


@pytest.mark.parametrize("quiet", [0, 5])
def test_merging_in_any_order(quiet):
    rng = random.Random(quiet)
    times = [rng.randrange(300) for _ in range(80)]
    some = [keyed.merged([(t, t, 1) for t in times[k::5]], quiet) for k in range(5)]
    assert keyed.merged([s for part in some for s in part], quiet) == stretches(times, quiet)


def held(spark, state, variable):
    """Values in the store, however many rows they hold."""
    return spark.read.format("statestore").option("path", state).option("stateVarName", variable).load().count()


def test_sources_of_a_group_share_one_value_of_open_stretches(spark):
    rng = random.Random(3)
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    schema, sources = "source double, at_us long", [None, float("nan"), *map(float, range(300))]
    waves = [[(s, START + (k * 400 + rng.randrange(400)) * MINUTE) for s in sources for _ in range(3)] for k in range(2)]
    late = [(5.0, START), (float("nan"), START + MINUTE)]
    for k, rows in enumerate((waves[0], waves[1] + late)):
        wave(spark, folder, k, rows, schema)
        stream = S.read_stream(spark, f"{folder}/wave=*", schema).withColumn("at", F.timestamp_micros("at_us"))
        S.drain(keyed.settle(stream, "source", "at", 60 * MINUTE, groups=4), out=out, state=state)
    done = keyed.settled(spark, out, state)
    want = [(str(s), *x) for s in sources for x in stretches([t for rows in waves for r, t in rows if str(r) == str(s)], 60 * MINUTE)]
    assert sorted((str(r["source"]), r["first"], r["last"], r["n"]) for r in done.stretches.collect()) == sorted(want)
    assert sorted(str(r["source"]) for r in done.late.collect()) == ["5.0", "nan"]
    assert held(spark, state, "open") <= 4 < done.stretches.where("NOT closed").count()


def test_sources_of_a_group_share_one_value_of_pages(spark):
    rng = random.Random(4)
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    schema, sources = "source string, page long, n_items long, total long", [None, "", *map(str, range(300))]
    # Sources end by their total, by an empty page, or wait for a page that never comes.
    pages = [(s, i, 0 if k % 3 == 1 and i == 4 else 2, 6 if k % 3 == 0 else None) for k, s in enumerate(sources) for i in range(1, 6) if k % 3 != 2 or i != 2]
    want = [(s, i) for k, s in enumerate(sources) for i in range(1, (4, 5, 2)[k % 3])]
    rng.shuffle(pages)
    for k in range(2):
        wave(spark, folder, k, pages[k::2], schema)
        S.drain(keyed.pages(S.read_stream(spark, f"{folder}/wave=*", schema), "source", "page", "n_items", "total", groups=4), out=out, state=state)
    got = [(r["source"], r["page"]) for r in spark.read.parquet(out).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert keyed.state_rows(spark, state, "early").count() == 3 * len(sources[2::3])
    assert held(spark, state, "done") <= 4 and held(spark, state, "early") <= 4
    with pytest.raises(TypeError, match="plain value"):
        keyed.pages(S.read_stream(spark, f"{folder}/wave=*", "source array<long>, page long, n long, total long"), "source", "page", "n", "total")
