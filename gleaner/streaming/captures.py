"""Structured Streaming over captures that arrive as files.

The batch operators that need no state work on a stream as they are. What follows are the
ones that keep something between batches: totals, arrival numbers, seen keys and the store. What keeps
state for each source is in `keyed`.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gleaner.operators.counts import judged
from gleaner.operators.ordered import numbered
from gleaner.session import new_path
from gleaner.sources import store
from gleaner.sources.captures import CAPTURE

FILES_PER_BATCH = 1000


def read_stream(spark: SparkSession, path: str, schema: str = CAPTURE, per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Captures as they arrive: JSON lines in new files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def drain(
    stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, out: str | None = None, state: str | None = None
) -> DataFrame | None:
    """Run a stream over what is there and stop; the rows it wrote, unless `each` takes the batches.

    `out` and `state` name the folders of an earlier drain to go on from.
    """
    spark = stream.sparkSession
    out, state = out or new_path(spark, "out"), state or new_path(spark, "state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if each is None:
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(each)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if each is None else None


def totals(stream: DataFrame, type_col: str) -> DataFrame:
    """Running totals per type; write in update mode."""
    return stream.groupBy(type_col).agg(F.count(F.lit(1)).alias("total"))


def keep_latest(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for update-mode results: one dated copy per batch; `latest_values` reads the newest."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def latest_values(spark: SparkSession, path: str, keys: Sequence[str], value: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def first_seen(keys: Sequence[str], seen: str, out: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps a capture whose keys no earlier one had, over the whole life of the stream.

    The digests of the keys are a table with a folder for each batch; a batch is joined with those before it, so
    nothing has to be let go and nothing is held in memory. A repeated batch reads what came before it and writes its
    own folders again. Of captures with equal keys in one batch one is kept. Null keys are equal to one another.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Columns are told apart by their place, nulls by their absence.
        of = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{n}") for n, k in enumerate(keys)])), 256))
        once = batch.withColumn("__key", of).dropDuplicates(["__key"])
        if batch_id > 0:
            before = spark.read.schema("__seen binary, batch long").parquet(seen).where(F.col("batch") < batch_id).drop("batch")
            once = once.join(before, F.col("__key") == F.col("__seen"), "left_anti")
        once.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        new = spark.read.parquet(f"{out}/batch={batch_id}")
        new.select(F.col("__key").alias("__seen")).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    return write


def placed(stream: DataFrame) -> DataFrame:
    """Add where a row of a file stream comes from: `__file_at`, `__file`, `__block`. Call it on what `read_stream` gives."""
    return stream.select(
        "*",
        F.col("_metadata.file_modification_time").alias("__file_at"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
    )


def number_arrivals(out: str, counts: str, name: str = "arrival") -> Callable[[DataFrame, int], None]:
    """Batch writer that numbers the captures of a `placed` stream 1, 2, 3, ... in the order of their arrival.

    Order is batch, file (by the time it was written, then by name), place in the file. A batch's number of rows is
    kept, and the next begins where all before it end; a repeated batch has the same files and writes the same
    numbers again. Rows are numbered by a range partition, so neither a large file nor a large batch is one task's work.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = 0
        if batch_id > 0:
            earlier = spark.read.schema("n long, batch long").parquet(counts).where(F.col("batch") < batch_id)
            before = earlier.agg(F.sum("n")).first()[0]
        # The rows of a block are read in order by one task, so their ids rise with their places.
        order = ["__file_at", "__file", "__block", "__row"]
        rows = numbered(batch.withColumn("__row", F.monotonically_increasing_id()), [], order, name)
        seen = Observation()
        rows = rows.withColumn(name, F.col(name) + F.lit(before)).drop(*order).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        spark.range(1).select(F.lit(seen.get["n"]).cast("long").alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    return write


class Expectations(StreamingQueryListener):
    """Counts by type of whole runs, from metrics that Spark observes as batches pass: no query of their own.

    `watched` puts the metrics on a stream; each started stream is a run under the name of its query, and the counts
    of a batch replace those of an earlier try of it. `unmet` judges the runs that have ended.
    """

    METRIC = "gleaner_expectations"

    def __init__(self, expected: Sequence[tuple[str, str, int]]):
        self.expected = list(expected)
        self._names: dict[str, str] = {}
        self._counts: dict[tuple[str, int], list[int]] = {}
        self._ended: dict[str, threading.Event] = {}

    def watched(self, stream: DataFrame, type_col: str) -> DataFrame:
        wanted = [F.count(F.when(F.col(type_col) == t, 1)).alias(f"n{k}") for k, (t, _, _) in enumerate(self.expected)]
        return stream.observe(self.METRIC, *wanted)

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.METRIC)
        if row is not None:
            self._counts[event.progress.name, event.progress.batchId] = [row[f"n{k}"] for k in range(len(self.expected))]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._names.get(str(event.runId))
        self._ended.setdefault(name, threading.Event()).set()

    def run(self, stream: DataFrame, name: str, state: str, out: str) -> None:
        """Drain a watched stream as the run `name`, and wait until its last metrics are in."""
        ended = self._ended.setdefault(name, threading.Event())
        ended.clear()
        writer = stream.writeStream.queryName(name).option("checkpointLocation", state).trigger(availableNow=True)
        writer.format("parquet").option("path", out).start().awaitTermination()
        if not ended.wait(300):
            raise TimeoutError(f"no end of {name}")

    def unmet(self, spark: SparkSession) -> DataFrame:
        """run, type, op, expected, actual of every expectation that a run does not meet."""
        rows = []
        for run in sorted(self._ended):
            batches = [n for (name, _), n in self._counts.items() if name == run]
            total = [sum(n) for n in zip(*batches)] if batches else [0] * len(self.expected)
            rows += [(run, t, op, n, got) for (t, op, n), got in zip(self.expected, total)]
        frame = spark.createDataFrame(rows, "run string, type string, op string, expected long, actual long")
        return judged(frame).where(~F.col("met"))


def store_batches(frames: Callable[[DataFrame], dict[str, DataFrame]], base: str, emitted_at: Column | int) -> Callable[[DataFrame, int], None]:
    """Batch writer into the record store, one run per batch; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_records(frames(batch), base, f"batch-{batch_id}", emitted_at)

    return write
