import random

import pytest

from pyspark.sql import functions as F

from gleaner.operators import graph, typegraph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "node long, next long")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_follow_long_chain(spark):
    e = edges(spark, [(i, i + 1) for i in range(300)])
    got = graph.follow(e, spark.createDataFrame([("s", 0), ("t", 290), ("u", 999)], "start string, node long"))
    assert pairs(got) == sorted(
        [("s", i, i) for i in range(301)] + [("t", i, i - 290) for i in range(290, 301)] + [("u", 999, 0)]
    )


def test_follow_cycle_visits_once(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (3, 1)])
    got = graph.follow(e, spark.createDataFrame([("s", 0)], "start string, node long"))
    assert pairs(got) == [("s", 0, 0), ("s", 1, 1), ("s", 2, 2), ("s", 3, 3)]


def test_on_cycle(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 7), (8, 8), (9, None)])
    assert sorted(r[0] for r in graph.on_cycle(e).collect()) == [1, 2, 3, 8]


def test_ancestors_random_forest(spark):
    r = random.Random(3)
    parent = {i: r.randrange(0, i) for i in range(1, 120) if r.random() < 0.9}
    want = []
    for i in range(120):
        at, d = parent.get(i), 1
        while at is not None:
            want.append((i, at, d))
            at, d = parent.get(at), d + 1
    assert pairs(graph.ancestors(edges(spark, list(parent.items())))) == sorted(want)


def test_ancestors_leave_out_chains_into_a_cycle(spark):
    e = edges(spark, [(1, 2), (2, 1), (3, 1), (4, 5)])
    assert pairs(graph.ancestors(e)) == [(4, 5, 1)]


def test_closure_and_cycles_of_a_digraph(spark):
    r = random.Random(5)
    es = sorted({(r.randrange(30), r.randrange(30)) for _ in range(40)})
    reach = {a: {b for x, b in es if x == a} for a in range(30)}
    for _ in range(30):
        reach = {a: s | {c for b in s for c in reach[b]} for a, s in reach.items()}
    e = edges(spark, es)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    assert pairs(graph.closure_from(e, nodes)) == sorted((a, b) for a, s in reach.items() for b in s)
    assert sorted(x[0] for x in typegraph.cyclic_jobs(e).collect()) == sorted(a for a, s in reach.items() if a in s)


@pytest.mark.parametrize("n", [1, 2])
def test_terminal_of_nested_chains(spark, n):
    e = edges(spark, [(1, 2), (2, 3), (4, 5), (5, 4)])
    jobs = spark.createDataFrame([(1,), (3,), (4,)], "job long")
    assert pairs(typegraph.terminal_stages(e, jobs)) == [(1, 3), (3, 3)]


def test_extension_problems(spark):
    types = spark.createDataFrame(
        [("A", None), ("B", "A"), ("C", "B"), ("D", "Gone"), ("X", "Y"), ("Y", "X")], "type string, parent string"
    )
    fields = spark.createDataFrame(
        [
            ("A", 0, "id", "String", False),
            ("A", 1, "n", "Int", True),
            ("B", 0, "extra", "Double", True),
            ("C", 0, "n", "String", True),
            ("C", 1, "id", "String", False),
        ],
        "type string, position int, field string, kind string, optional boolean",
    )
    got = sorted((r["type"], r["problem"], r["field"]) for r in typegraph.extension_problems(types, fields).collect())
    assert got == [
        ("C", "incompatible field", "n"),
        ("D", "unknown parent", None),
        ("X", "cycle", None),
        ("Y", "cycle", None),
    ]
    flat = typegraph.flatten_fields(types, fields).filter("type = 'C'").orderBy("place").collect()
    assert [(r["field"], r["owner"], r["kind"]) for r in flat] == [
        ("id", "C", "String"),
        ("n", "C", "String"),
        ("extra", "B", "Double"),
    ]


def test_ends_keep_one_row_for_each_node(spark, monkeypatch):
    from gleaner.operators import graph

    n, most = 100_000, []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda d, name="": most.append(real(d, name)) or most[-1])
    chain = spark.range(1, n + 1).select(F.col("id").alias("node"), (F.col("id") - 1).alias("next"))
    loop = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-4, -1)], "node long, next long")
    got = graph.ends(chain.unionByName(loop)).groupBy("end").count().collect()
    assert [tuple(r) for r in got] == [(0, n)]
    assert len(most) <= 18 and all(d.count() <= n + 4 for d in most[::5])


def components_brute(pairs):
    """Each node on a cycle with the least node that it reaches and that reaches it."""
    onward = {}
    for a, b in pairs:
        onward.setdefault(a, set()).add(b)
    reach = {}
    for a in onward:
        seen, todo = set(), [a]
        while todo:
            for b in onward.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return sorted((a, min(b for b in reach[a] if a in reach.get(b, ()))) for a in reach if a in reach[a])


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_digraphs(spark, seed):

    rng = random.Random(seed)
    pairs = []
    for block in range(6):
        n = rng.randint(2, 9)
        pairs += [(block * 20 + rng.randrange(n), block * 20 + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        pairs += [(block * 20 + i, block * 20 + i + 1) for i in range(10, 10 + rng.randint(0, 6))]
        pairs += [(block * 20 + rng.randrange(n), 10 + rng.randrange(110)) for _ in range(rng.randint(0, 2))]
    e = edges(spark, pairs + [(None, 3), (4, None)])
    assert sorted(map(tuple, graph.cycles(e).collect())) == components_brute(pairs)


def test_a_long_ring_with_long_tails_takes_few_rounds(spark):
    n = 3000
    ring = [(i, (i + 1) % n) for i in range(n)]
    tails = [(100_000 + i, 100_001 + i) for i in range(1500)] + [(101_500, 7), (11, 200_000)] + [(200_000 + i, 200_001 + i) for i in range(1500)]
    lone = [(300_000 + i, 300_000 + (i + 1) % 500) for i in range(500)]
    got = sorted(map(tuple, graph.cycles(edges(spark, ring + tails + lone)).collect()))
    assert got == [(i, 0) for i in range(n)] + [(300_000 + i, 300_000) for i in range(500)]
    assert graph.cycles(edges(spark, [(1, 2)]).limit(0)).count() == 0
