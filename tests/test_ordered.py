"""Ordered scans against brute force, with one group holding most of the rows and many blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators.ordered import first_rows, look_back, numbered, order_statistic, running

R = random.Random(7)
ROWS = [
    ("hot" if R.random() < 0.6 else R.choice(["a", "b", None, "z"]), i * 3 % 2003, R.choice([None, 1, 2, 5]))
    for i in range(2003)
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, at int, v long").repartition(5)


def rows(frame):
    return sorted((tuple(map(str, r)) for r in frame.collect()))


@pytest.mark.parametrize("blocks", [1, 2, 13, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running(df, blocks, descending):
    got = running(
        df, ["k"], ["at"], sums={"s": F.col("v"), "n": F.lit(1)}, last={"l": F.col("v")}, descending=descending, blocks=blocks
    )
    by = F.desc("at") if descending else F.asc("at")
    w = Window.partitionBy("k").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.last("v", True).over(w).alias("l")
    )
    assert rows(got) == rows(want)


def test_running_over_everything(df):
    got = {r["at"]: r["n"] for r in numbered(df, [], ["at"], "n", blocks=9).collect()}
    assert got == {at: at + 1 for at in range(2003)}


def test_hot_group_spans_blocks(df):
    from gleaner.operators import ordered

    kept = []
    real = ordered.stored
    try:
        ordered.stored = lambda d, name="": kept.append(real(d, name)) or kept[-1]
        running(df, ["k"], ["at"], sums={"n": F.lit(1)}, blocks=20).count()
    finally:
        ordered.stored = real
    per_block = kept[0].groupBy("__block").count()
    assert per_block.count() == 20
    assert per_block.agg(F.max("count")).first()[0] < 400
    assert kept[0].filter("k = 'hot'").select("__block").distinct().count() > 5


@pytest.mark.parametrize("size", [7, 50, 5000])
def test_look_back(df, size):
    got = look_back(df, ["k"], ["at"], 7, lambda w: {"p": F.collect_list("at").over(w)}, size=size, blocks=6)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(-7, -1)
    assert rows(got) == rows(df.withColumn("p", F.collect_list("at").over(w)))


def test_one_path_at_every_size(df, monkeypatch):
    """The number of blocks changes nothing, and nothing is counted beforehand: one write for each scan."""
    from gleaner.operators import ordered

    written = []
    real = ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda d, name="": written.append(1) or real(d, name))
    plain = rows(running(df, ["k"], ["at"], sums={"n": F.lit(1)}))
    assert len(written) == 1
    for blocks in (1, 3, 40):
        assert rows(running(df, ["k"], ["at"], sums={"n": F.lit(1)}, blocks=blocks)) == plain


def test_look_back_needs_room(df):
    with pytest.raises(ValueError):
        look_back(df, ["k"], ["at"], 7, lambda w: {}, size=3)


def test_first_rows_cut_before_shuffle(df):
    top = first_rows(df, ["k"], [F.desc("at")], 3)
    want = {}
    for k, at, _ in ROWS:
        want.setdefault(k, []).append(at)
    assert rows(top.select("k", "at")) == sorted((str(k), str(a)) for k, v in want.items() for a in sorted(v)[-3:])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_order_statistic(df):
    some = df.filter("v is not null")
    got = {r["k"]: r["m"] for r in order_statistic(some.filter("k is not null"), ["k"], "v", ["at"], lambda n: F.floor(n / 2), "m").collect()}
    want = {}
    for k, _, v in ROWS:
        if k and v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in want.items()}
