"""A lookup source: rows under integer keys, kept by key range, of which a job reads the ranges it needs, once each.

A transform that asks a service for one key at a time becomes a join with this table. What the join needs is pushed to
the source as a filter on the key, so ranges without a wanted key are neither listed in the plan's partitions nor read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

RANGE = "key_range"
NAME = "gleaner_lookup"


class _Range(InputPartition):
    """One folder of keys."""

    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class LookupReader(DataSourceReader):
    """Reads the ranges that the pushed filters on the key leave. Filters on other columns stay with Spark."""

    def __init__(self, path: str, key: str, width: int, schema: T.StructType):
        self.path, self.key, self.width, self.schema = path, key, width, schema
        self.least, self.most, self.among = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != (self.key,) or getattr(f, "value", None) is None:
                yield f
            elif isinstance(f, EqualTo):
                self._among([f.value])
            elif isinstance(f, In):
                self._among([v for v in f.value if v is not None])
            elif isinstance(f, GreaterThanOrEqual):
                self._within(f.value, None)
            elif isinstance(f, GreaterThan):
                self._within(f.value + 1, None)
            elif isinstance(f, LessThanOrEqual):
                self._within(None, f.value)
            elif isinstance(f, LessThan):
                self._within(None, f.value - 1)
            else:
                yield f

    def _among(self, values: list[int]) -> None:
        self.among = set(values) if self.among is None else self.among & set(values)

    def _within(self, least: int | None, most: int | None) -> None:
        self.least = max((x for x in (self.least, least) if x is not None), default=None)
        self.most = min((x for x in (self.most, most) if x is not None), default=None)

    def _wanted(self, number: int) -> bool:
        first, last = number * self.width, (number + 1) * self.width - 1
        if self.least is not None and last < self.least or self.most is not None and first > self.most:
            return False
        return self.among is None or any(first <= v <= last for v in self.among)

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.path)
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith(f"{RANGE}=")]
        return [_Range(p) for p in sorted(found) if self._wanted(int(p.rsplit("=", 1)[1]))]

    def read(self, partition: _Range):
        fs, _ = _opened(self.path)
        key, test = ds.field(self.key), None
        for one in (
            None if self.least is None else key >= self.least,
            None if self.most is None else key <= self.most,
            None if self.among is None else key.isin(sorted(self.among)),
        ):
            if one is not None:
                test = one if test is None else test & one
        table = ds.dataset(partition.folder, filesystem=fs, format="parquet", exclude_invalid_files=False)
        kind = to_arrow_schema(self.schema)  # files may hold narrower numbers than were asked for
        for batch in table.to_batches(columns=self.schema.names, filter=test, batch_size=10_000):
            yield from pa.Table.from_batches([batch]).cast(kind).to_batches()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Lookup(DataSource):
    """Options: `path`, `key`, `width` of a range. The schema is the reader's to give."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema) -> LookupReader:
        return LookupReader(self.options["path"], self.options["key"], int(self.options["width"]), schema)


def write_lookup(table: DataFrame, key: str, path: str, width: int) -> None:
    """Keep a table by ranges of `width` integer keys; rows with a null key are left out, as no lookup can ask for them."""
    rows = table.where(F.col(key).isNotNull()).withColumn(RANGE, F.floor(F.col(key) / width))
    rows.repartition(RANGE).write.partitionBy(RANGE).parquet(path)


def read_lookup(spark: SparkSession, path: str, key: str, width: int, schema: str) -> DataFrame:
    """The whole table; filters on the key go to the source.

    Take a frame of its own for each filter: Spark 4.1 keeps what was last pushed with the loaded frame, so one that was
    filtered and is then read whole, or by what cannot be pushed, would still leave out the ranges of that filter.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Lookup)
    return spark.read.format(NAME).schema(schema).option("path", path).option("key", key).option("width", width).load()


def needed(table: DataFrame, key: str, records: DataFrame, asked: str) -> DataFrame:
    """The part of a lookup table, read for this alone, that the keys of some records lie in: from the least asked key to the greatest."""
    ends = records.agg(F.min(asked).alias("least"), F.max(asked).alias("most")).first()
    if ends["least"] is None:
        return table.where(F.lit(False))
    return table.where((F.col(key) >= F.lit(ends["least"])) & (F.col(key) <= F.lit(ends["most"])))
