"""Run history, sessions and counts over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.value import epoch_micros
from gleaner.operators import counts, history, sessions
from gleaner.plans import query

RUNS_SQL = """WITH c AS (SELECT floor(epoch(ts) / 21600)::BIGINT AS b, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2),
      r AS (SELECT b, CASE WHEN coalesce(sum(n) FILTER (type = 'error'), 0) > coalesce(sum(n) FILTER (type = 'view'), 0) THEN 'fail' ELSE 'ok' END AS outcome FROM c GROUP BY b),
      ok AS (SELECT b, row_number() OVER (ORDER BY b) AS i FROM r WHERE outcome = 'ok'),
      prior AS (SELECT r.b, ok.b AS pb, row_number() OVER (PARTITION BY r.b ORDER BY ok.b DESC) AS k FROM r JOIN ok ON ok.b < r.b),
      types AS (SELECT DISTINCT type FROM c),
      grid AS (SELECT r.b, types.type, coalesce(n, 0) AS n FROM r CROSS JOIN types LEFT JOIN c ON c.b = r.b AND c.type = types.type)"""


@query(
    "prior_ok_window",
    f"""{RUNS_SQL} SELECT 'sr-' || r.b AS id, coalesce(string_agg('sr-' || pb, ',' ORDER BY pb), '') AS prior FROM r LEFT JOIN prior ON prior.b = r.b AND k <= 7 GROUP BY r.b""",
)
def prior_ok_window(t):
    return history.prior_ok(t.runs, F.col("id")).select("id", F.array_join("prior", ",").alias("prior"))


@query(
    "run_health",
    f"""{RUNS_SQL}, med AS (SELECT p.b, g.type, median(g.n) AS m FROM prior p JOIN grid g ON g.b = p.pb WHERE k <= 7 GROUP BY 1, 2),
      enough AS (SELECT b FROM prior GROUP BY b HAVING count(*) >= 3),
      drift AS (SELECT DISTINCT med.b FROM med JOIN grid g ON g.b = med.b AND g.type = med.type JOIN enough ON enough.b = med.b WHERE m > 0 AND g.n <= m * 0.7::DOUBLE)
    SELECT 'sr-' || b AS id, CASE WHEN outcome = 'fail' THEN 'fail' WHEN b IN (SELECT b FROM drift) THEN 'drift' ELSE 'ok' END AS health FROM r""",
)
def run_health(t):
    return history.health(t.runs).select("id", "health")


@query(
    "median_even",
    f"{RUNS_SQL} SELECT 'sr-' || b AS id, median(n) AS mid FROM c GROUP BY b",
)
def median_even(t):
    return t.runs.select("id", history.median(F.map_values("counts")).alias("mid"))


@query(
    "count_delta",
    f"""{RUNS_SQL}, p AS (SELECT b, lag(b) OVER (ORDER BY b) AS pb FROM r)
    SELECT 'sr-' || c.b AS id, c.type, c.n, coalesce(c.n - q.n, 0) AS delta,
      CASE WHEN c.n = 0 THEN 'failing' WHEN coalesce(c.n - q.n, 0) < -5 THEN 'warning' ELSE 'good' END AS class
    FROM c JOIN p ON p.b = c.b LEFT JOIN c q ON q.b = p.pb AND q.type = c.type""",
)
def count_delta(t):
    rows = history.count_delta(t.runs)
    return rows.select("id", "type", "n", "delta", history.delta_class(F.col("n"), F.col("delta")).alias("class"))


SERIES_SQL = f"""{RUNS_SQL}, shown AS (SELECT type FROM c WHERE b = (SELECT max(b) FROM r)), s AS (SELECT * FROM grid WHERE type IN (SELECT type FROM shown)),
      mid AS (SELECT type, list_sort(list(n))[count(*) // 2 + 1] AS m, count(*) AS points, arg_max(n, b) AS last FROM s GROUP BY type)"""


@query("count_series", f"""{SERIES_SQL} SELECT type, b * 21600000 AS "at", n FROM s""")
def count_series(t):
    return history.count_series(t.runs).select("type", "at", "n")


@query("anomaly_points", f"""{SERIES_SQL} SELECT s.type, s.b * 21600000 AS "at", s.n FROM s JOIN mid USING (type) WHERE points >= 3 AND m > 0 AND s.n <= m * 0.7::DOUBLE""")
def anomaly_points(t):
    return history.anomalies(history.count_series(t.runs)).select("type", "at", "n")


@query(
    "trend_class",
    f"{SERIES_SQL} SELECT type, last, CASE WHEN last = 0 THEN 'failing' WHEN m > 0 AND last < m * 0.95::DOUBLE THEN 'warning' ELSE 'good' END AS trend FROM mid",
)
def trend_class(t):
    return history.trend(history.count_series(t.runs)).select("type", "last", "trend")


@query(
    "outcome_tally",
    f"{RUNS_SQL}, recent AS (SELECT * FROM r ORDER BY b DESC LIMIT 30) SELECT 'events' AS run_id, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'fail') AS failed FROM recent",
)
def outcome_tally(t):
    return history.outcome_tally(t.runs)


@query(
    "run_row",
    f"""{RUNS_SQL} 
      , d AS (SELECT floor(epoch(ts) / 21600)::BIGINT AS b, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000 AS seconds FROM events GROUP BY 1)
    SELECT 'sr-' || r.b AS id, outcome, sum(n) AS records, max(n) AS largest, round(any_value(seconds), 3) AS seconds
    FROM r JOIN c ON c.b = r.b JOIN d ON d.b = r.b GROUP BY r.b, outcome""",
)
def run_row(t):
    n = F.map_values("counts")
    return t.runs.select(
        "id",
        "outcome",
        F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).alias("records"),
        F.array_max(n).alias("largest"),
        F.round("seconds", 3).alias("seconds"),
    )


@query(
    "progress_pct",
    f"""{RUNS_SQL}, p AS (SELECT b, lag(b) OVER (ORDER BY b) AS pb FROM r), total AS (SELECT b, sum(n)::DOUBLE AS n FROM c GROUP BY b)
    SELECT 'sr-' || p.b AS id, CASE WHEN q.n > 0 THEN round(least(100.0, v.n / q.n * 100), 6) END AS views, CASE WHEN o.n > 0 THEN round(least(100.0, a.n / o.n * 100), 6) END AS records
    FROM p JOIN total a ON a.b = p.b LEFT JOIN total o ON o.b = p.pb
      LEFT JOIN grid v ON v.b = p.b AND v.type = 'view' LEFT JOIN c q ON q.b = p.pb AND q.type = 'view'""",
)
def progress_pct(t):
    from gleaner.operators.ordered import look_back

    runs = look_back(t.runs, ["run_id"], ["at", "id"], 1, lambda w: {"prev": F.first("counts").over(w)})
    of = lambda m: F.coalesce(F.try_element_at(m, F.lit("view")), F.lit(0))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    return runs.select(
        "id",
        F.round(counts.progress(of(F.col("counts")), F.try_element_at("prev", F.lit("view"))), 6).alias("views"),
        F.round(counts.progress(total(F.col("counts")), total(F.col("prev"))), 6).alias("records"),
    )


@query(
    "running_total",
    "SELECT event_id, event_type AS type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS total FROM events",
)
def running_total(t):
    rows = t.events.select("event_id", F.col("event_type").alias("type"))
    return counts.running_total(rows, "type", ["event_id"])


EXPECTED = [("view", ">", 0), ("click", ">=", 1000000000), ("refund", "==", 0), ("refund", ">", 0), ("error", "!=", 5), ("signup", "<=", 1)]


@query(
    "expect_count",
    "WITH e(type, op, expected) AS (VALUES ('click', '>=', 1000000000), ('refund', '>', 0), ('signup', '<=', 1)) SELECT type, op, expected, (SELECT count(*) FROM events WHERE event_type = type) AS actual, false AS met FROM e",
)
def expect_count(t):
    return counts.unmet(t.events, EXPECTED, "event_type")


@query("group_records", "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def group_records(t):
    return counts.group_records(t.events, "event_type", "event_id")


@query(
    "session_runs",
    """WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM events),
      x AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id, session) AS ended, max(session) OVER (PARTITION BY user_id) AS final FROM e),
      s AS (SELECT user_id, session, min(event_id) AS from_event_id, any_value(ended) AS to_event_id, arg_min(event_type, CASE WHEN event_id = ended THEN event_id END) AS how, any_value(final) AS final,
        count(*) FILTER (event_type IN ('click', 'view') AND (ended IS NULL OR event_id < ended)) AS emitted FROM x WHERE session > 0 GROUP BY 1, 2)
    SELECT user_id, session, from_event_id, to_event_id, CASE WHEN how = 'purchase' THEN 'ok' WHEN how = 'error' OR session = final THEN 'fail' ELSE 'running' END AS outcome,
      CASE WHEN to_event_id IS NULL AND session = final THEN 'cancelled' END AS error, emitted FROM s""",
)
def session_runs(t):
    kind = F.col("event_type")
    return sessions.session_runs(
        t.events.select("user_id", "event_id", "event_type"),
        "user_id",
        ["event_id"],
        start=kind == "signup",
        success=kind == "purchase",
        failure=kind == "error",
        emitted=kind.isin("click", "view"),
    )


@query(
    "emit_bursts",
    """WITH e AS (SELECT *, sum(CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS burst FROM events)
    SELECT user_id, burst, event_type, count(*) AS n, min(event_id) AS first_event_id FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3""",
)
def emit_bursts(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return sessions.emit_bursts(rows, "user_id", ["event_id"], F.col("event_type").isin("click", "view"), "event_type")


@query(
    "step_stats",
    """WITH e AS (SELECT user_id, event_id, event_type AS k, epoch_us(ts) AS at_us, CAST(json_extract_string(props, '$.k') AS BIGINT) // 25 AS step FROM events),
      f AS (SELECT *, last_value(CASE WHEN k = 'click' THEN step END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS cur FROM e),
      s AS (SELECT user_id, CASE WHEN k IN ('click', 'view') THEN step ELSE cur END AS step, count(*) FILTER (k = 'click') AS requests, count(*) FILTER (k = 'purchase') AS emits,
        min(at_us) FILTER (k = 'click') AS t0, max(at_us) FILTER (k = 'view') AS t1, max(event_id) FILTER (k = 'click') AS sent,
        max(event_id) FILTER (k IN ('signup', 'error')) AS ended, max(event_id) FILTER (k = 'error') AS failed
        FROM f WHERE CASE WHEN k IN ('click', 'view') THEN step ELSE cur END IS NOT NULL GROUP BY 1, 2),
      q AS (SELECT *, max(sent) OVER (PARTITION BY user_id) AS newest FROM s WHERE requests > 0)
    SELECT user_id, step, requests, emits, CASE WHEN t1 >= t0 THEN t1 - t0 END AS duration, newest > sent OR coalesce(ended > sent, false) AS done, coalesce(failed > sent, false) AS failed FROM q""",
)
def step_stats(t):
    kind = F.col("event_type")
    rows = t.events.select(
        "user_id",
        "event_id",
        "event_type",
        epoch_micros(F.col("ts")).alias("at_us"),
        F.floor(F.get_json_object("props", "$.k").cast("long") / 25).alias("k"),
    )
    return sessions.step_stats(
        rows,
        "user_id",
        ["event_id"],
        step=F.col("k"),
        sent=kind == "click",
        received=kind == "view",
        emitted=kind == "purchase",
        succeeded=kind == "signup",
        failed=kind == "error",
        at=F.col("at_us"),
    )


