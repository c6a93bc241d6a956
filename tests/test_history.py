import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import history, sessions


def runs(spark, counts, run="r"):
    return spark.createDataFrame(
        [(run, f"{run}{i}", i, o, c) for i, (o, c) in enumerate(counts)], "run_id string, id string, at long, outcome string, counts map<string,int>"
    )


def last_health(spark, counts, **kw):
    return history.health(runs(spark, counts), **kw).orderBy(F.desc("at")).first()["health"]


@pytest.mark.parametrize("n,want", [(60, "drift"), (80, "ok"), (70, "drift"), (71, "ok")])
def test_golden_drift(spark, n, want):
    assert last_health(spark, [("ok", {"A": 100})] * 7 + [("ok", {"A": n})]) == want


@pytest.mark.parametrize(
    "counts,want",
    [
        ([("ok", {"A": 100})] * 2 + [("ok", {"A": 1})], "ok"),
        ([("ok", {"A": 100})] * 3 + [("ok", {})], "drift"),
        ([("ok", {"A": 100})] * 3 + [("fail", {"A": 100})], "fail"),
        ([("ok", {"A": 0})] * 5 + [("ok", {"A": 0})], "ok"),
        ([("ok", {"A": 1})] * 5 + [("ok", {"A": 100})] * 7 + [("ok", {"A": 70})], "drift"),
        ([("ok", {"A": 100})] * 2 + [("fail", {})] * 9 + [("ok", {"A": 100}), ("ok", {"A": 10})], "drift"),
        ([("ok", {"A": 100, "B": 9})] * 4 + [("ok", {"A": 100, "C": 5})], "drift"),
    ],
)
def test_health(spark, counts, want):
    assert last_health(spark, counts, blocks=4) == want


def test_paused(spark):
    assert last_health(spark, [("fail", {})], enabled=F.lit(False)) == "paused"


def test_prior_ok_skips_failures(spark):
    r = random.Random(2)
    log = [("ok" if r.random() < 0.6 else "fail", {"A": i}) for i in range(60)]
    got = {x["at"]: x["p"] for x in history.prior_ok(runs(spark, log), F.col("at"), "p", blocks=5).collect()}
    want = {i: [j for j in range(i) if log[j][0] == "ok"][-7:] for i in range(60)}
    assert got == want


def test_anomalies_and_trend(spark):
    log = runs(spark, [("ok", {"A": n, "B": 1}) for n in (10, 10, 7, 10, 9)])
    series = history.count_series(log)
    assert [(r["type"], r["at"]) for r in history.anomalies(series).collect()] == [("A", 2)]
    assert {r["type"]: r["trend"] for r in history.trend(series).collect()} == {"A": "warning", "B": "good"}
    short = history.count_series(runs(spark, [("ok", {"A": 9}), ("ok", {"A": 1})]))
    assert history.anomalies(short).count() == 0


def test_delta(spark):
    log = runs(spark, [("ok", {"A": 10}), ("ok", {"A": 3, "B": 2}), ("ok", {"A": 0})])
    got = sorted((r["at"], r["type"], r["delta"]) for r in history.count_delta(log, blocks=2).collect())
    assert got == [(0, "A", 0), (1, "A", -7), (1, "B", 0), (2, "A", -3)]


def brute_sessions(log):
    out, current, n = [], None, 0
    for seq, kind in log:
        if kind == "start":
            n += 1
            current = {"session": n, "outcome": "running", "emitted": 0, "error": None}
            out.append(current)
        elif kind == "emit" and current:
            current["emitted"] += 1
        elif kind in ("ok", "fail") and current:
            current["outcome"] = kind
            current = None
    if current:
        current.update(outcome="fail", error="cancelled")
    return [(o["session"], o["outcome"], o["error"], o["emitted"]) for o in out]


@pytest.mark.parametrize("blocks", [1, 11])
def test_sessions_against_replay(spark, blocks):
    r = random.Random(4)
    events = [("hot" if r.random() < 0.7 else f"u{r.randrange(4)}", i, r.choice(["start", "emit", "emit", "ok", "fail", "other"])) for i in range(900)]
    df = spark.createDataFrame(events, "log string, seq long, kind string")
    k = F.col("kind")
    got = sessions.session_runs(df, "log", ["seq"], k == "start", k == "ok", k == "fail", k == "emit", blocks=blocks)
    found = {}
    for x in got.orderBy("log", "session").collect():
        found.setdefault(x["log"], []).append((x["session"], x["outcome"], x["error"], x["emitted"]))
    want = {log: brute_sessions([(s, kk) for lg, s, kk in events if lg == log]) for log in {e[0] for e in events}}
    assert found == {k: v for k, v in want.items() if v}
    bursts = sessions.emit_bursts(df, "log", ["seq"], k == "emit", "kind", blocks=blocks)
    want_bursts = []
    for log in sorted({e[0] for e in events}):
        run = 0
        for _, s, kk in [e for e in events if e[0] == log] + [(log, None, "end")]:
            if kk == "emit":
                run += 1
            elif run:
                want_bursts.append((log, run))
                run = 0
    assert sorted((x["log"], x["n"]) for x in bursts.collect()) == sorted(want_bursts)


def brute_steps(events):
    stats, current, start = {}, None, {}
    for seq, kind, step in events:
        if kind == "sent":
            s = stats.setdefault(step, {"requests": 0, "emits": 0, "duration": None})
            s.update(requests=s["requests"] + 1, done=False, failed=False)
            start.setdefault(step, seq)
            if current is not None and current != step:
                stats[current]["done"] = True
            current = step
        elif kind == "received" and step in stats:
            stats[step]["duration"] = seq - start[step]
        elif kind == "emitted" and current is not None:
            stats[current]["emits"] += 1
        elif kind in ("ok", "fail") and current is not None:
            stats[current]["done"] = True
            if kind == "fail":
                stats[current]["failed"] = True
    return {k: (v["requests"], v["emits"], v["duration"], v["done"], v["failed"]) for k, v in stats.items()}


def test_steps_against_replay(spark):
    r = random.Random(9)
    events = [("hot" if r.random() < 0.8 else "b", i, r.choice(["sent", "received", "emitted", "emitted", "ok", "fail"]), r.choice("xyz")) for i in range(60)]
    df = spark.createDataFrame(events, "run string, seq long, kind string, step string")
    k = F.col("kind")
    got = sessions.step_stats(df, "run", ["seq"], F.col("step"), k == "sent", k == "received", k == "emitted", k == "ok", k == "fail", F.col("seq"), blocks=7)
    found = {(x["run"], x["step"]): (x["requests"], x["emits"], x["duration"], x["done"], x["failed"]) for x in got.collect()}
    want = {(run, s): v for run in ("hot", "b") for s, v in brute_steps([e[1:] for e in events if e[0] == run]).items()}
    assert found == want
