"""Recorded traffic: one row per captured exchange, browser response or rendered document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import path_exists

# All kinds in one wide row; fields of the other kinds are null.
CAPTURE = (
    "seq long, kind string, subkind string, url string, method string, "
    "request_headers map<string,string>, request_body string, status int, "
    "response_headers map<string,string>, body string, html string"
)
CORRUPT = "_corrupt_record"


def exchange(url: Column, method: Column, status: Column, headers: Column, body: Column) -> list[Column]:
    """The columns of an http capture."""
    return [
        F.lit("http").alias("kind"),
        F.lit(None).cast("string").alias("subkind"),
        url.alias("url"),
        method.alias("method"),
        status.cast("int").alias("status"),
        headers.alias("response_headers"),
        body.alias("body"),
    ]


def read_captures(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines of captures; blank lines are skipped, a missing path is an empty table.

    Strict fails on a line that is not JSON. Otherwise such lines come back with their text in
    `_corrupt_record`, to be split off by `quarantine`; `bad_lines` tells their files and line numbers.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], CAPTURE)
    if strict:
        return spark.read.schema(CAPTURE).json(path, mode="FAILFAST")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{CAPTURE}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("c")).select("c.*")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with `file`, `block` (where their split begins) and `at`, which rises with their place in it."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add `line`, the number from 1 of a line in its file, to some rows of `placed_lines`.

    Lines are counted by split, splits are summed by file, and a row's place in its split is added: no file is read
    by one task, and only counts and the rows asked for are shuffled. `lines` must be the frame the rows come from.
    """
    splits = lines.groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        rows.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
        .withColumn("line", F.col("at") - F.col("_first") + F.col("_before") + 1)
        .drop("_file", "_block", "_first", "_before", "at", "block")
    )


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no captures: `(file, line, value)`; blank lines count but are never bad."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string, file string, line long")
    lines = placed_lines(spark, path)
    parsed = F.from_json("value", f"{CAPTURE}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    bad = lines.withColumn("_c", parsed).where((F.trim("value") != "") & F.col(f"_c.{CORRUPT}").isNotNull()).drop("_c")
    return with_line_numbers(bad, lines)


def quarantine(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that could not be read."""
    bad = F.col(CORRUPT).isNotNull()
    return captures.filter(~bad).drop(CORRUPT), captures.filter(bad).select(F.col(CORRUPT).alias("line"))


def parse_captures(lines: DataFrame, column: str = "line", strict: bool = True) -> DataFrame:
    """Captures from a text column of JSON lines."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    text = lines.filter(F.trim(column) != "")
    return text.select(F.from_json(column, CAPTURE, mode).alias("c")).select("c.*")


def write_captures(captures: DataFrame, path: str) -> None:
    """One JSON object per line, files compressed; absent fields are left out."""
    captures.write.json(path, ignoreNullFields=True, compression="gzip")


def http(captures: DataFrame) -> DataFrame:
    return captures.filter(F.col("kind") == "http")


def matches(captures: DataFrame) -> DataFrame:
    return captures.filter((F.col("kind") == "browser") & (F.col("subkind") == "match"))


def documents(captures: DataFrame) -> DataFrame:
    return captures.filter((F.col("kind") == "browser") & (F.col("subkind") == "document"))


def content_type(headers: Column) -> Column:
    """The Content-Type header in any case, without parameters, lower case; blank counts as absent."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "content-type")
    mime = F.lower(F.trim(F.split_part(F.get(named, F.lit(0))["value"], F.lit(";"), F.lit(1))))
    return F.when(mime != "", mime)


def is_json(body: Column) -> Column:
    return F.coalesce(F.try_parse_json(body).isNotNull() & (body != ""), F.lit(False))


def decode_body(headers: Column, body: Column, override: str | None = None) -> Column:
    """`{format, value, text}`: JSON bodies as VARIANT, others (and broken JSON) as text, empty as null.

    The format is the override, else what the Content-Type says, else JSON if the body parses.
    """
    some = F.when(body != "", body)

    def decoded(declared: Column) -> Column:
        wanted = F.when(F.coalesce(declared, F.lit("json")) == "json", some)
        return _bind(F.try_parse_json(wanted), lambda value: result(declared, value))

    def result(declared: Column, value: Column) -> Column:
        guessed = F.when(value.isNull(), F.lit("text")).otherwise(F.lit("json"))
        return F.struct(
            F.coalesce(declared, guessed).alias("format"), value.alias("value"), F.when(value.isNull(), some).alias("text")
        )

    if override:
        return decoded(F.lit(override))
    return _bind(content_type(headers), lambda mime: _bind(_format_of(mime), decoded))


def _format_of(mime: Column) -> Column:
    return (
        F.when(mime.startswith("application/json") | mime.endswith("+json"), F.lit("json"))
        .when(mime == "text/html", F.lit("html"))
        .when(mime.startswith("application/xml") | (mime == "text/xml") | mime.endswith("+xml"), F.lit("xml"))
        .when(mime.isNotNull(), F.lit("text"))
    )


def _bind(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row: a lambda variable is not evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def capture_body(body: Column) -> Column:
    """`{value, text}`: JSON if the body parses, else its text."""
    value = F.try_parse_json(body)
    return F.struct(value.alias("value"), F.when(value.isNull(), body).alias("text"))
