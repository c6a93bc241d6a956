"""Types that extend types, and jobs made of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.graph import ancestors, closure_from, cycles, ends, on_cycle
from gleaner.operators.iterate import for_each
from gleaner.session import stored


def _parents(types: DataFrame) -> DataFrame:
    return types.filter(F.col("parent").isNotNull()).select(F.col("type").alias("node"), F.col("parent").alias("next"))


def lineage(types: DataFrame) -> DataFrame:
    """`(type, ancestor, depth)` with the type itself at depth 0; types on or above a cycle only themselves."""
    up = ancestors(_parents(types)).select(F.col("node").alias("type"), "ancestor", "depth")
    return types.select("type", F.col("type").alias("ancestor"), F.lit(0).cast("long").alias("depth")).unionByName(up)


def flatten_fields(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Effective fields of every type: `(type, field, kind, optional, owner, place)`.

    `types` is `(type, parent)`, `fields` is `(type, position, field, kind, optional)`. The
    nearest declaration of a field wins; its place is where the oldest ancestor put it.
    """
    inherited = (
        lineage(types)
        .join(fields.withColumnRenamed("type", "ancestor"), "ancestor")
        .groupBy("type", "field")
        .agg(
            F.min_by(F.struct("kind", "optional", F.col("ancestor").alias("owner")), "depth").alias("near"),
            F.max_by(F.struct((-F.col("depth")).alias("d"), "position"), "depth").alias("slot"),
        )
    )
    # A type has as many fields as were declared for it: a small window per type.
    place = F.row_number().over(Window.partitionBy("type").orderBy("slot.d", "slot.position"))
    return inherited.select("type", "field", "near.*", place.alias("place"))


def flatten_alignments(types: DataFrame, alignments: DataFrame) -> DataFrame:
    """Distinct alignments of every type and its ancestors: `(type, ontology, term)`."""
    return (
        lineage(types)
        .join(alignments.withColumnRenamed("type", "ancestor"), "ancestor")
        .select("type", "ontology", "term")
        .distinct()
    )


def extension_problems(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Unknown parents, cycles, and fields a child redeclares with another type or optionality."""
    parents = _parents(types)
    cycle = stored(on_cycle(parents), "cycle")
    unknown = parents.join(types.select(F.col("type").alias("next")), "next", "left_anti").select(
        F.col("node").alias("type"), F.lit("unknown parent").alias("problem"), F.lit(None).cast("string").alias("field")
    )
    cyclic = cycle.select(
        F.col("node").alias("type"), F.lit("cycle").alias("problem"), F.lit(None).cast("string").alias("field")
    )
    above = (
        ancestors(parents, cycle)
        .select(F.col("node").alias("type"), "ancestor", "depth")
        .join(fields.select(F.col("type").alias("ancestor"), "field", F.struct("kind", "optional").alias("__up")), "ancestor")
    )
    nearest = above.groupBy("type", "field").agg(F.min_by("__up", "depth").alias("__up"))
    changed = (
        fields.join(nearest, ["type", "field"])
        .filter((F.col("kind") != F.col("__up.kind")) | (F.col("optional") != F.col("__up.optional")))
        .select("type", F.lit("incompatible field").alias("problem"), "field")
    )
    return unknown.unionByName(cyclic).unionByName(changed)


def field_type_refs(fields: DataFrame, kind: str) -> DataFrame:
    """Type names a field's type mentions, through arrays and references: adds `ref`.

    Types are written `Array(T)`, `Ref(T)` or a name; the scalar names refer to nothing.
    """
    names = F.filter(
        F.regexp_extract_all(kind, F.lit(r"[A-Za-z_]\w*"), F.lit(0)),
        lambda n: ~n.isin("Array", "Ref", "String", "Int", "Double", "Bool"),
    )
    return for_each(fields, names, "ref")


def boundary_problems(stages: DataFrame, signatures: DataFrame) -> DataFrame:
    """Neighbouring stages that do not fit: `(chain, position, problem)`.

    `stages` is `(chain, position, job)` and `signatures` is `(job, outputs, inputs)` with
    arrays of type names; an input `[T]` or `T` takes a stream of `T`.
    """
    have = signatures.select("job", "outputs", "inputs")
    here = stages.join(have, "job").select("chain", "position", "outputs")
    follows = stages.join(have, "job").select(
        "chain", (F.col("position") - 1).alias("position"), F.col("inputs").alias("next_inputs")
    )
    pairs = here.join(follows, ["chain", "position"])
    out = F.get("outputs", F.lit(0))
    fits = F.exists("next_inputs", lambda t: (t == out) | (t == F.concat(F.lit("["), out, F.lit("]"))))
    problem = F.when(F.size("outputs") != 1, F.lit("emits not exactly one type")).when(~fits, F.lit("no input slot"))
    return pairs.select("chain", "position", problem.alias("problem")).filter(F.col("problem").isNotNull())


def terminal_stages(last_stage: DataFrame, jobs: DataFrame) -> DataFrame:
    """The job each chain ends in, through nested chains: `(job, terminal)`.

    `last_stage` is `(node, next)`. A chain that runs into itself has no terminal.
    """
    at = ends(last_stage)
    onward = last_stage.filter(F.col("next").isNotNull()).select(F.col("node").alias("job"))
    alone = jobs.select("job").join(onward, "job", "left_anti").select("job", F.col("job").alias("terminal"))
    return jobs.select("job").join(at, F.col("job") == F.col("node")).select("job", F.col("end").alias("terminal")).unionByName(alone)


def stage_closure(stages: DataFrame, roots: DataFrame) -> DataFrame:
    """All jobs each root reaches: `(root, node)`."""
    return closure_from(stages, roots)


def cyclic_jobs(stages: DataFrame) -> DataFrame:
    """Jobs that reach themselves, with the cycle they are part of: `(node, component)`, named by its least job."""
    return cycles(stages)
