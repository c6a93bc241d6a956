"""Inputs of a job: a JSON object of values, small enough to be constants, and lists as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_inputs(spark: SparkSession, path: str) -> dict:
    """The object in a JSON file; anything but an object is an error."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one file, found {len(rows)}")
    value = json.loads(rows[0]["value"])
    if not isinstance(value, dict):
        raise ValueError(f"{path}: inputs must be a JSON object")
    return value


def constants(inputs: dict) -> dict[str, Column]:
    """Scalar inputs as literals, to be used in any expression."""
    return {k: F.lit(v) for k, v in inputs.items() if v is None or isinstance(v, (str, int, float, bool))}


def table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A list input as rows, read by the executors."""
    listed = F.from_json("value", f"{name} array<struct<{schema}>>", {"mode": "FAILFAST"})[name]
    return spark.read.text(path, wholetext=True).select(F.inline(listed))
