"""From raw documents to packed training sequences: each stage works on what the one before it kept.

`STAGES` are written and read back one after the other; all but the last return the columns of `documents`. Every
stage handles null texts, repeated rows and empty tables as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import jaccard, pii, quality, queries, toxicity
from gleaner.session import stored

# Packing and compression have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit. Fitted on labels of what is here, but for the held-out fold."""
    model, score = queries.toxicity_model(docs, spark, sf_dir), free_name(docs, "_score")
    return toxicity.scored(docs, "text", model, score).where(F.col(score) < queries.TOXIC_FROM).drop(score)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; rules are tried in the order that a sample gives."""
    have = quality.measures()
    rules = [*quality.base_rules(have=have), *quality.text_rules(have=have)]
    sample = stored(quality.measured(quality.sample_of(docs.select("text"))), "sample")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = quality.measured(docs.select(row, "text"))
    return rows.where(quality.cascade(quality.ordered(sample, rules)).isNull()).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: of its least id, and the least of rows that share the id.

    A row without an id has one made of its text for this, above those of rows that have one (unless theirs are over
    2^62), so rows without an id are copies like others, and those of equal text are one document.
    """
    own = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))
    found = stored(jaccard.near_duplicates(keyed.select(key, "text"), key), "components")
    ids = found.groupBy("id").agg(F.max(F.col("id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("n"))
    odd = stored(ids.where("gone OR n > 1").select(F.col("id").alias(key), "gone"), "odd")
    once = keyed.join(odd, key, "left_anti").select(*docs.columns)
    again = odd.where("NOT gone").select(key)
    if again.isEmpty():
        return once
    rows = keyed.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.unionByName(rows.select("_row.*"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same length."""
    return pii.pseudonymised(docs, "text", queries.PII_KEY, spans=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    return queries.pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_junk),
    ("near_copies", drop_copies),
    ("private_data", hide_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
