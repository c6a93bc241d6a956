"""Streaming queries: captures arrive as files and are drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.value import epoch_micros
from gleaner.operators.iterate import emit
from gleaner.operators.matching import match_rules, url_key
from gleaner.plans import query
from gleaner.plans.paging import PAGES_SQL, customer_pages
from gleaner.plans.tables import Tables
from gleaner.session import new_path, stored
from gleaner.sources import captures as C
from gleaner.sources import store
from gleaner.streaming import captures as S
from gleaner.streaming import keyed

KINDS = [("shop", "/(click|view)"), ("account", "/(signup|purchase)")]
LIVE = C.CAPTURE + ", at_us long"  # JSON timestamps would lose their microseconds


def _live(t: Tables) -> DataFrame:
    """Event captures with the time they were taken."""
    at = t.events.select(F.col("event_id").alias("seq"), epoch_micros(F.col("ts")).alias("at_us"))
    return C.matches(t.web_captures).join(at, "seq")


def _folder(t: Tables) -> str:
    """Event captures as JSON lines in several files, in the order of `seq`."""
    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _folders:
        path = new_path(t.spark, "live")
        C.write_captures(_live(t).repartitionByRange("seq"), path)
        _folders[key] = path
    return _folders[key]


_folders: dict[tuple, str] = {}


def _typed(stream: DataFrame) -> DataFrame:
    return stream.withColumns({"type": F.regexp_extract("url", r"app\.test/([a-z]+)", 1), "at": F.timestamp_micros("at_us")})


def _stream(t: Tables) -> DataFrame:
    """Two files per batch, so that a drain takes several batches."""
    return _typed(S.read_stream(t.spark, _folder(t), LIVE, per_batch=2))


@query(
    "stream_captures",
    """WITH w AS (SELECT event_id % 3 AS wave, event_type AS type, count(*) AS n, sum(length(props)) AS chars FROM events GROUP BY 1, 2),
      t AS (SELECT wave, sum(n) AS n FROM w GROUP BY 1), e AS (SELECT wave, n, sum(n) OVER (ORDER BY wave) AS last FROM t)
    SELECT w.wave, type, w.n, chars::BIGINT AS chars, (last - e.n + 1)::BIGINT AS first, last::BIGINT AS last, true AS rising FROM w JOIN e ON e.wave = w.wave""",
)
def stream_captures(t):
    """Captures come in three waves of files. For each wave and type: how many, their bodies' length, the wave's arrival
    numbers, and whether numbers follow one another without a gap, in the order of `seq`, in every file."""
    live, folder = _live(t), new_path(t.spark, "arriving")
    out, counts, state = (new_path(t.spark, n) for n in ("arrived", "arrival_counts", "arrival_state"))
    for wave in range(3):
        C.write_captures(live.where(F.col("seq") % 3 == wave).repartitionByRange("seq").sortWithinPartitions("seq"), f"{folder}/wave={wave}")
        rows = _typed(S.placed(S.read_stream(t.spark, f"{folder}/wave=*", LIVE))).withColumn("file", F.col("__file"))
        S.drain(rows.select("seq", "type", "body", "file", "__file_at", "__file", "__block"), each=S.number_arrivals(out, counts), state=state)
    # A file has as many rows as its writer gave it.
    before = Window.partitionBy("file").orderBy("seq")
    got = t.spark.read.parquet(out).withColumn("wave", F.regexp_extract("file", r"wave=(\d)", 1).cast("long"))
    got = got.withColumn("follows", F.coalesce(F.col("arrival") - F.lag("arrival").over(before) == 1, F.lit(True)))
    whole = got.groupBy(F.col("wave").alias("_wave")).agg(F.min("arrival").alias("first"), F.max("arrival").alias("last"), F.bool_and("follows").alias("rising"))
    parts = got.groupBy("wave", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("body")).alias("chars"))
    return parts.join(whole, F.col("wave") == F.col("_wave")).drop("_wave")


@query(
    "stream_emit",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'shop' ELSE 'account' END AS rule, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_type <> 'error'""",
)
def stream_emit(t):
    hits = match_rules(_stream(t), KINDS).withColumn("doc", F.from_json("body", "k long"))
    records = emit(hits, "Hit", {"rule": F.col("rule"), "seq": F.col("seq"), "k": F.col("doc.k")}, [F.col("rule_no"), F.col("seq")])
    return S.drain(records).select("rule", "seq", "k")


@query("stream_totals", "SELECT event_type AS type, count(*) AS total FROM events GROUP BY 1")
def stream_totals(t):
    path = new_path(t.spark, "totals")
    S.drain(S.totals(_stream(t), "type"), "update", S.keep_latest(path))
    return S.latest_values(t.spark, path, ["type"], "total")


GAP = 60
SETTLE_SQL = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS at_us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
      s AS (SELECT *, sum(CASE WHEN prev IS NULL OR at_us - prev > {GAP * 60000000} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_us) AS session FROM e)
    SELECT user_id::VARCHAR AS source, min(at_us) AS from_us, max(at_us) + {GAP * 60000000} AS until_us, count(*) AS n, false AS late FROM s GROUP BY user_id, session"""


@query("stream_settle", SETTLE_SQL)
def stream_settle(t):
    """All stretches, those still open at the end too, and captures that came too late (none: waves are in order of time)."""
    live, folder = stored(_live(t), "timed"), new_path(t.spark, "settling")
    out, state = new_path(t.spark, "settled"), new_path(t.spark, "settle_state")
    ends = live.agg(F.percentile_approx("at_us", [0.25, 0.5, 0.75])).first()[0] or [0, 0, 0]
    wave = F.lit(0)
    for e in ends:
        wave = wave + (F.col("at_us") > e).cast("int")
    for k in range(len(ends) + 1):
        C.write_captures(live.where(wave == k), f"{folder}/wave={k}")
        stream = _typed(S.read_stream(t.spark, f"{folder}/wave=*", LIVE)).withColumn("source", F.regexp_extract("url", r"user=(\d+)", 1))
        S.drain(keyed.settle(stream, "source", "at", GAP * 60_000_000), out=out, state=state)
    done = keyed.settled(t.spark, out, state)
    both = done.stretches.select("source", "first", "last", "n", F.lit(False).alias("late")).unionByName(done.late.withColumn("late", F.lit(True)))
    return both.select("source", F.col("first").alias("from_us"), (F.col("last") + GAP * 60_000_000).alias("until_us"), "n", "late")


@query("stream_dedup", "SELECT event_type AS type, count(DISTINCT (user_id, props)) AS n FROM events GROUP BY 1")
def stream_dedup(t):
    """The same request with the same answer counts once, however much later it comes."""
    rows = _stream(t).withColumns({"key": url_key(F.col("url")), "hash": F.sha2("body", 256)}).select("method", "key", "hash", "type", "at")
    seen, out = new_path(t.spark, "seen"), new_path(t.spark, "once")
    S.drain(rows, each=S.first_seen(["method", "key", "hash"], seen, out))
    return t.spark.read.parquet(out).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


RUN_EXPECTED = [("click", ">=", 1000000000), ("refund", ">", 0), ("signup", "<=", 1), ("view", ">", 0)]


@query(
    "stream_expect",
    """WITH e(type, op, expected) AS (VALUES ('click', '>=', 1000000000), ('refund', '>', 0), ('signup', '<=', 1), ('view', '>', 0)),
      r AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM events),
      a AS (SELECT run, type, op, expected, (SELECT count(*) FROM r WHERE r.run = k.run AND event_type = type) AS actual
        FROM e, (VALUES ('even'), ('odd')) k(run))
    SELECT run, type, op, expected, actual, false AS met FROM a
    WHERE NOT CASE op WHEN '>=' THEN actual >= expected WHEN '>' THEN actual > expected ELSE actual <= expected END""",
)
def stream_expect(t):
    """Two runs, each over the captures of its users; the counts are seen as the batches pass."""
    listener = S.Expectations(RUN_EXPECTED)
    t.spark.streams.addListener(listener)
    try:
        user = F.regexp_extract("url", r"user=(\d+)", 1).cast("long")
        for run, rest in (("even", 0), ("odd", 1)):
            rows = listener.watched(_stream(t).where(user % 2 == rest), "type").select("seq", "type")
            listener.run(rows, run, new_path(t.spark, "run_state"), new_path(t.spark, "run_out"))
    finally:
        t.spark.streams.removeListener(listener)
    return listener.unmet(t.spark)


@query("stream_store", "SELECT 'Hit-' || event_id AS _id, event_type AS type FROM events")
def stream_store(t):
    base = new_path(t.spark, "store")

    def frames(batch):
        return {"Hit": emit(batch, "Hit", {"type": F.col("type")}, [F.col("seq")])}

    S.drain(_stream(t), each=S.store_batches(frames, base, 1700000000000))
    return store.load_records(t.spark, base, "Hit").select("_id", "type")


@query("stream_pages", f"{PAGES_SQL} SELECT o_custkey AS source, ceil(i / 3.0)::BIGINT AS page_no FROM n GROUP BY 1, 2")
def stream_pages(t):
    """Pages come in any order, dealt over waves of files by a hash."""
    folder, out, state = (new_path(t.spark, n) for n in ("pages_in", "pages_out", "pages_state"))
    doc = F.from_json("body", "list array<long>, total long")
    rows = customer_pages(t).select("source", "page_no", F.size(doc["list"]).alias("n_items"), doc["total"].alias("total"))
    for wave in range(3):
        rows.where(F.pmod(F.xxhash64("source", "page_no"), F.lit(3)) == wave).write.json(f"{folder}/wave={wave}")
        stream = S.read_stream(t.spark, f"{folder}/wave=*", "source long, page_no long, n_items int, total long")
        S.drain(keyed.pages(stream, "source", "page_no", "n_items", "total"), out=out, state=state)
    return t.spark.read.parquet(out).select("source", F.col("page").alias("page_no"))
