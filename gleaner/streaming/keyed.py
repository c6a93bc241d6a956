"""Operators that keep state for each source, in a RocksDB store beside the stream's checkpoint.

A call of the state store costs far more than a row, so sources are dealt into a fixed number of groups and a group's
state is read and written at once. A batch touches the groups of the sources that are in it and those whose timers fire,
no other. Rows are
not dropped by the watermark on their way here: the event time goes on as a plain number, so a late row still reaches
the operator, which puts it aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
# Calls of the state store grow with the groups, what a call moves with the sources in one.
GROUPS = 4096
# Rows held or sent on at once while a group's rows pass.
CHUNK = 10_000


def with_keyed_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, as keyed state needs. A stream keeps the store it was begun with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def merged(stretches: Iterable[tuple[int, int, int]], quiet: int) -> list[tuple[int, int, int]]:
    """Stretches (first, last, n) put together where no more than `quiet` lies between them."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(stretches):
        if out and a - out[-1][1] <= quiet:
            a, b, n = out[-1][0], max(b, out[-1][1]), n + out.pop()[2]
        out.append((a, b, n))
    return out


def _group(source: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(groups)).cast("int").alias("group")


def _columns(source: T.StructField, *numbers: str) -> list[T.StructField]:
    """Rows of many sources in one: an array for the sources and one for each number."""
    if isinstance(source.dataType, (T.ArrayType, T.StructType, T.MapType)):
        raise TypeError(f"a source is a plain value, not {source.dataType.simpleString()}")
    types = [("source", source.dataType)] + [(n, T.LongType()) for n in numbers]
    return [T.StructField(n, T.ArrayType(t)) for n, t in types]


def _rows(df: DataFrame, *keep: str) -> DataFrame:
    """Arrays of `_columns` taken apart, beside the columns to keep."""
    return df.select(*keep, F.inline(F.arrays_zip(*[c for c in df.columns if c not in keep])))


def _name(source):
    """The source as a key of a dictionary: NaN is equal to itself."""
    return source if source == source else math.nan


class _Table:
    """A group's rows in one value of the state store, which costs by the value rather than by the row."""

    def __init__(self, handle, name: str, columns: list[T.StructField]):
        self.state = handle.getValueState(name, T.StructType(columns))

    def get(self) -> list[tuple]:
        had = self.state.get()
        return list(zip(*had)) if had else []

    def put(self, rows: list[tuple]) -> None:
        if rows:
            self.state.update(tuple(map(list, zip(*rows))))
        else:
            self.state.clear()


class _Settle(StatefulProcessor):
    """Open stretches of a group of sources. All times are microseconds; timers and the watermark are milliseconds."""

    def __init__(self, source: T.StructField, quiet: int, grain: int):
        self.source, self.quiet, self.grain = source, quiet, grain

    def init(self, handle) -> None:
        self.handle = handle
        self.open = _Table(handle, "open", _columns(self.source, "first", "last", "n"))

    def _out(self, kind: str, rows: list[tuple]) -> Iterator[Row]:
        if rows:
            source, first, last, n = map(list, zip(*rows))
            yield Row(kind=kind, source=source, first=first, last=last, n=n)

    def _close(self, stretches: Iterable[tuple], watermark_ms: int) -> Iterator[Row]:
        """Give out the stretches that are over and hold the others; a timer is set for the first of them to end."""
        # A row on time can be one grain older than the watermark.
        end = watermark_ms * 1000 - self.quiet - self.grain
        left = [s for s in stretches if s[2] >= end]
        yield from self._out("stretch", [s for s in stretches if s[2] < end])
        self.open.put(left)
        if left:
            self.handle.registerTimer((min(s[2] for s in left) + self.quiet + self.grain) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new: dict[object, list[tuple[int, int, int]]] = {}
        late: list[tuple] = []
        n, limit = 0, CHUNK
        for r in rows:
            if (r.slot + 1) * self.grain <= watermark * 1000:
                late.append((r.source, r.first, r.last, r.n))
                if len(late) >= CHUNK:
                    yield from self._out("late", late)
                    late = []
                continue
            new.setdefault(_name(r.source), []).append((r.first, r.last, r.n))
            n += 1
            if n > limit:
                new = {s: merged(mine, self.quiet) for s, mine in new.items()}
                n = sum(map(len, new.values()))
                limit = max(limit, 2 * n)
        yield from self._out("late", late)
        if new:
            now = []
            for s, *stretch in self.open.get():
                if _name(s) in new:
                    new[_name(s)].append(tuple(stretch))
                else:
                    now.append((s, *stretch))
            now += [(s, *x) for s, mine in new.items() for x in merged(mine, self.quiet)]
            yield from self._close(now, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._close(self.open.get(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _slots(stream: DataFrame, grain: int) -> DataFrame:
    """Captures of a source and grain of time as one row for each task's batch: slot, first, last, n.

    A busy source sends one row a grain and batch, however many captures it has.
    """
    out = T.StructType([stream.schema["source"], *T._parse_datatype_string("slot long, first long, last long, n long").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Floored, so that times before 1970 have slots of one width too.
            at = b.column(1)
            part = pc.divide(at, grain)
            slot = pc.if_else(pc.greater(pc.multiply(part, grain), at), pc.subtract(part, 1), part)
            t = pa.table([b.column(0), slot, at], ["source", "slot", "at"])
            g = t.group_by(["source", "slot"]).aggregate([("at", "min"), ("at", "max"), ("at", "count")])
            cols = [g.column(c).combine_chunks() for c in ("source", "slot", "at_min", "at_max", "at_count")]
            yield pa.RecordBatch.from_arrays(cols, ["source", "slot", "first", "last", "n"])

    return stream.mapInArrow(run, out)


def settle(stream: DataFrame, source: str, at: str, quiet: int, late: str = "1 hour", grain: int = SECOND, groups: int = GROUPS) -> DataFrame:
    """Stretches of a source with no gap longer than `quiet` microseconds, and captures that came too late.

    Rows are (kind, source, first, last, n): `stretch` comes out once the watermark, `late` behind the latest capture,
    shows that nothing can be added to it; `late` are captures, counted by `grain`, that the watermark had passed when
    they came. What is open when a stream ends stays in its state: `settled` reads it. A null source is a source; a
    capture without a time belongs to no stretch and is `late` at once. A checkpoint keeps the `groups` it was begun with.
    """
    with_keyed_state(stream.sparkSession)
    timed = stream.withWatermark(at, late).select(F.col(source).alias("source"), F.coalesce(F.unix_micros(at), F.lit(-(1 << 62))).alias("at"))
    held = timed.schema["source"]
    kind = T.StructType([T.StructField("kind", T.StringType()), *_columns(held, "first", "last", "n")])
    slots = _slots(timed, grain).withColumn("group", _group("source", groups)).groupBy("group")
    return _rows(slots.transformWithState(_Settle(held, quiet, grain), kind, "append", "eventTime"), "kind")


@dataclass(frozen=True)
class Settled:
    """`stretches`: source, first, last, n, closed. `late`: source, first, last, n. Each capture is in one of them."""

    stretches: DataFrame
    late: DataFrame


def settled(spark: SparkSession, out: str, state: str) -> Settled:
    """What a drained `settle` has written to `out`, and the stretches that its checkpoint `state` still holds open."""
    rows = spark.read.parquet(out)
    held = state_rows(spark, state, "open").select("*", F.lit(False).alias("closed"))
    closed = rows.where("kind = 'stretch'").select("source", "first", "last", "n", F.lit(True).alias("closed"))
    return Settled(closed.unionByName(held), rows.where("kind = 'late'").drop("kind"))


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The rows of one state variable of a stopped stream, for its last batch."""
    return _rows(spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load().select("value.*"))


class _Pages(StatefulProcessor):
    """Pages of a group of sources in the order of their numbers; those that came early wait."""

    def __init__(self, source: T.StructField, first: int):
        self.source, self.first = source, first

    def init(self, handle) -> None:
        self.done = _Table(handle, "done", _columns(self.source, "next", "items", "over"))
        self.early = _Table(handle, "early", _columns(self.source, "page", "n_items", "total"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done = {_name(s): x for s, *x in self.done.get()}
        waiting: dict[object, dict[int, tuple]] = {}
        for s, page, *what in self.early.get():
            waiting.setdefault(_name(s), {})[page] = tuple(what)
        touched, begun = set(), (self.first, 0, 0)
        for r in rows:
            s = _name(r.source)
            at, _, over = done.get(s, begun)
            if not over and r.page is not None and r.page >= at:
                waiting.setdefault(s, {}).setdefault(r.page, (r.n_items, r.total))
                touched.add(s)
        kept = []
        for s in touched:
            mine = waiting[s]
            at, items, over = done.get(s, begun)
            while not over and at in mine:
                n, total = mine.pop(at)
                kept.append((s, at))
                items += n or 0
                over = int(not n or (total is not None and items >= total))
                at += 1
            if over:
                mine.clear()
            done[s] = (at, items, over)
        if kept:
            source, page = map(list, zip(*kept))
            yield Row(source=source, page=page)
            self.done.put([(s, *x) for s, x in done.items()])
        if touched:
            self.early.put([(s, page, *x) for s, mine in waiting.items() for page, x in mine.items()])

    def close(self) -> None:
        pass


def pages(stream: DataFrame, source: str, page: str, n_items: str, total: str, first: int = 1, groups: int = GROUPS) -> DataFrame:
    """The pages (source, page) to keep: in order from `first` until a source has its total, or an empty page.

    Pages may come in any order: one that is ahead waits in the state until the gap before it closes, one that came
    before is not kept twice, and of two with one number in a batch either is. Pages after the stop are not kept.
    A null page number is left out; a page without a number of items counts as empty; without a total only an empty
    page stops. A checkpoint keeps the `groups` it was begun with.
    """
    with_keyed_state(stream.sparkSession)
    rows = stream.select(
        F.col(source).alias("source"), F.col(page).cast("long").alias("page"), F.col(n_items).cast("long").alias("n_items"), F.col(total).cast("long").alias("total")
    )
    held = rows.schema["source"]
    grouped = rows.withColumn("group", _group("source", groups)).groupBy("group")
    return _rows(grouped.transformWithState(_Pages(held, first), T.StructType(_columns(held, "page")), "append", "none"))
