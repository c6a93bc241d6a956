"""Chains of stages: the records of one are the input of the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.iterate import prior_rows

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Job:
    """A stage with its signature: what its input must hold and the one type it emits."""

    run: Stage
    emits: str
    needs: dict[str, str] | None = None  # field name -> Spark type


def compose(first: DataFrame, stages: Sequence[Job]) -> DataFrame:
    """Run the stages in turn as one plan; nothing is written between them.

    The outer input reaches the first stage only. Boundaries are checked on schemas, before
    any data is read.
    """
    records = first
    for i, job in enumerate(stages):
        given = records if i == 0 else prior_rows(records)
        have = {f.name: f.dataType.simpleString() for f in given.schema.fields}
        for name, kind in (job.needs or {}).items():
            if have.get(name) != kind:
                raise ValueError(f"stage {i} ({job.emits}) needs {name} {kind}, upstream has {have.get(name)}")
        records = job.run(given)
    return records


def adapt(parent: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of a parent type as rows of a child type: added fields are null."""
    have = set(parent.columns)
    return parent.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
