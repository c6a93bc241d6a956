"""Checks on record tables; each returns the offending rows or counts as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.types import Catalog

# Shapes of registry names.
AUTHOR = r"^[a-z0-9][a-z0-9-]{0,38}$"
TYPE_NAME = r"^[A-Z][A-Za-z0-9]{0,63}$"


def nulls_in(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Null count of each required field, in one pass."""
    found = records.agg(
        F.array(*[F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNull()).alias("nulls")) for f in fields]).alias("c")
    )
    return found.select(F.inline("c"))


def outside_enum(records: DataFrame, field: str, variants: Sequence[str]) -> DataFrame:
    """Values that are no variant, with their count."""
    return (
        records.filter(F.col(field).isNotNull() & ~F.col(field).isin(*variants))
        .groupBy(F.col(field).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def uncovered(records: DataFrame, field: str, labels: Sequence[str]) -> DataFrame:
    """Values without a branch and labels no value uses: rows `(label, problem)`."""
    values = records.groupBy(F.col(field).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    extra = values.filter(F.col("label").isNotNull() & ~F.col("label").isin(*labels)).select(
        "label", F.lit("not covered").alias("problem")
    )
    used = records.agg(
        F.array(
            *[
                F.struct(F.lit(v).alias("label"), F.coalesce(F.bool_or(F.col(field) == v), F.lit(False)).alias("used"))
                for v in labels
            ]
        ).alias("c")
    )
    unused = used.select(F.inline("c")).filter(~F.col("used")).select("label", F.lit("unknown variant").alias("problem"))
    return extra.unionByName(unused)


def unknown_fields(records: DataFrame, catalog: Catalog, name: str) -> list[str]:
    declared = {f.name for f in catalog.flatten(name).fields}
    return [c for c in records.columns if c not in declared and not c.startswith("_")]


def bind_columns(records: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Cast to the store's columns: anything to text, doubles cut to integers, integers widened.

    A null in a required column raises, or with `strict=False` goes to `_bind_error`.
    """
    from gleaner.functions.number import truncate_to_int
    from gleaner.functions.text import double_text

    out, missing = [], []
    for f in schema.fields:
        have = records.schema[f.name].dataType if f.name in records.columns else T.NullType()
        c = F.col(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType) and isinstance(have, T.DoubleType):
            bound = F.when(c.isNotNull(), double_text(c))
        elif isinstance(f.dataType, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
            bound = F.to_json(c)
        elif isinstance(f.dataType, T.LongType) and isinstance(have, T.DoubleType):
            bound = truncate_to_int(c)
        elif isinstance(f.dataType, (T.LongType, T.DoubleType)) and isinstance(have, T.StringType):
            bound = F.when(c.isNotNull(), F.raise_error(F.lit(f"field {f.name} is declared a number"))).cast(f.dataType)
        else:
            bound = c.cast(f.dataType)
        if not f.nullable:
            if strict:
                bound = F.when(bound.isNull(), F.raise_error(F.lit(f"required field {f.name} missing or null"))).otherwise(bound)
            else:
                missing.append(F.when(c.isNull(), F.lit(f.name)))
        out.append(bound.alias(f.name))
    kept = [F.col(c) for c in records.columns if c not in schema.fieldNames()]
    if strict:
        return records.select(*out, *kept)
    error = F.array_join(F.array_compact(F.array(*missing)), ",") if missing else F.lit("")
    return records.select(*out, *kept, F.when(error != "", error).alias("_bind_error"))


def alignment_problems(alignments: DataFrame, owner: str, uri: str) -> DataFrame:
    """Alignments without ontology or term, and those declared twice by one owner."""
    ontology = F.split_part(uri, F.lit("/"), F.lit(1))
    term = F.when(F.contains(uri, F.lit("/")), F.expr(f"substring({uri}, locate('/', {uri}) + 1)")).otherwise(F.lit(""))
    malformed = alignments.filter((ontology == "") | (term == "")).select(owner, uri, F.lit("malformed").alias("problem"))
    twice = (
        alignments.groupBy(owner, uri).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        .select(owner, uri, F.lit("duplicate").alias("problem"))
    )
    return malformed.distinct().unionByName(twice)


def type_ref_problems(refs: DataFrame, owner: str, author: str, name: str, version: str) -> DataFrame:
    """Type pins with a bad author, name or version, and names one owner pins twice."""
    problem: Column = (
        F.when(~F.coalesce(F.rlike(author, F.lit(AUTHOR)), F.lit(False)), F.lit("author"))
        .when(~F.coalesce(F.rlike(name, F.lit(TYPE_NAME)), F.lit(False)), F.lit("name"))
        .when(~F.coalesce(F.col(version) >= 1, F.lit(False)), F.lit("version"))
    )
    shaped = refs.select(owner, author, name, problem.alias("problem")).filter(F.col("problem").isNotNull())
    twice = (
        refs.groupBy(owner, author, name).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        .select(owner, author, name, F.lit("duplicate").alias("problem"))
    )
    return shaped.distinct().unionByName(twice)


def count_problems(stored_counts: DataFrame, counts: str, key: Sequence[str], actual: DataFrame) -> DataFrame:
    """Stored counts that are negative or differ from the rows: `(*key, type, stored, actual)`.

    `actual` has the key columns, `type` and `n`.
    """
    claimed = stored_counts.select(*key, F.explode(counts).alias("type", "stored"))
    real = actual.select(*key, "type", F.col("n").alias("actual"))
    both = claimed.join(real, [*key, "type"], "full_outer").withColumns(
        {"stored": F.coalesce("stored", F.lit(0)), "actual": F.coalesce("actual", F.lit(0))}
    )
    return both.filter((F.col("stored") < 0) | (F.col("stored") != F.col("actual")))


def undeclared(names: DataFrame, used: str, catalog: DataFrame, declared: str) -> DataFrame:
    """Uses of a type or enum name the catalog lacks."""
    known = catalog.select(F.col(declared).alias("__known")).distinct()
    return names.join(known, F.col(used) == F.col("__known"), "left_anti")


def report(**parts: DataFrame) -> DataFrame:
    """One diagnostics table `(kind, detail)`: each part is a table of problems."""
    out = None
    for kind, df in parts.items():
        rows = df.select(
            F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("detail")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def report_by_run(**parts: DataFrame) -> DataFrame:
    """One diagnostics table `(run, kind, detail)`: each part is a table of problems with the `run` they belong to."""
    out = None
    for kind, df in parts.items():
        rest = [c for c in df.columns if c != "run"]
        rows = df.select("run", F.lit(kind).alias("kind"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out
