"""Declared record types: what a job may emit, and the table schemas that follow from it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REF = T.StructType([T.StructField("_ref", T.StringType()), T.StructField("_type", T.StringType())])


@dataclass(frozen=True)
class Ref:
    """A field that points at an emitted record of type `to`."""

    to: str


@dataclass(frozen=True)
class Enum:
    name: str
    variants: tuple[str, ...]


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType | Ref | Enum
    optional: bool = False
    alignment: str | None = None  # "ontology/term"

    def spark_type(self) -> T.DataType:
        if isinstance(self.type, Ref):
            return REF
        return T.StringType() if isinstance(self.type, Enum) else self.type

    @property
    def required(self) -> bool:
        return isinstance(self.type, Ref) or not self.optional


@dataclass(frozen=True)
class RecordType:
    name: str
    fields: tuple[Field, ...]
    alignments: tuple[str, ...] = ()
    extends: str | None = None


@dataclass
class Catalog:
    """Types by name. A later declaration of a name replaces the earlier one."""

    types: dict[str, RecordType] = field(default_factory=dict)

    @staticmethod
    def of(declared: Iterable[RecordType]) -> Catalog:
        return Catalog({t.name: t for t in declared})

    def merged(self, local: Catalog) -> Catalog:
        return Catalog({**self.types, **local.types})

    def flatten(self, name: str) -> RecordType:
        """Own and inherited fields: parents first, a redeclared field keeps its parent's place."""
        chain, seen, at = [], set(), name
        while at in self.types and at not in seen:
            seen.add(at)
            chain.append(self.types[at])
            at = chain[-1].extends
        fields: dict[str, Field] = {}
        alignments: dict[str, None] = {}
        for t in reversed(chain):
            fields.update({f.name: f for f in t.fields})
            alignments.update(dict.fromkeys(t.alignments))
        return RecordType(name, tuple(fields.values()), tuple(alignments), self.types[name].extends)

    def schema(self, name: str) -> T.StructType:
        """Table schema of a type; optional fields are nullable, alignments ride in metadata."""
        return T.StructType(
            [
                T.StructField(
                    f.name, f.spark_type(), not f.required, {"alignment": f.alignment} if f.alignment else {}
                )
                for f in self.flatten(name).fields
            ]
        )

    def output_schemas(self, emitted: Iterable[str]) -> dict[str, T.StructType]:
        """Schemas of the store tables of a job that emits these types."""
        extra = [
            T.StructField("_id", T.StringType(), False),
            T.StructField("_scheduled_run_id", T.StringType(), False),
            T.StructField("_emitted_at", T.LongType(), False),
        ]
        return {n: T.StructType(self.schema(n).fields + extra) for n in emitted}

    def field_table(self, spark: SparkSession) -> DataFrame:
        """The catalog as rows `(type, position, field, kind, required, alignment, target)`."""
        rows = [
            (
                t.name,
                i,
                f.name,
                f.spark_type().simpleString(),
                f.required,
                f.alignment,
                f.type.to if isinstance(f.type, Ref) else None,
            )
            for t in map(self.flatten, self.types)
            for i, f in enumerate(t.fields)
        ]
        return spark.createDataFrame(
            rows,
            "type string, position int, field string, kind string, required boolean, alignment string, target string",
        )


def check_emit(frame: DataFrame, catalog: Catalog, name: str) -> list[str]:
    """Problems of a frame against a declared type, found from the schema alone."""
    if name not in catalog.types:
        return [f"unknown type {name}"]
    declared = {f.name: f for f in catalog.flatten(name).fields}
    have = {f.name: f.dataType for f in frame.schema.fields if not f.name.startswith("_")}
    return (
        [f"missing required field {n}" for n, f in declared.items() if f.required and n not in have]
        + [f"unknown field {n}" for n in have if n not in declared]
        + [
            f"field {n} is {have[n].simpleString()}, declared {f.spark_type().simpleString()}"
            for n, f in declared.items()
            if n in have and have[n] != f.spark_type()
        ]
    )
