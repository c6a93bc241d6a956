"""JSON-LD output: a context from alignment metadata and a graph of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ontologies with a known base.
BASES = {
    "schema.org": "https://schema.org/",
    "wikidata": "http://www.wikidata.org/entity/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dublin-core": "http://purl.org/dc/terms/",
}


def alignment_iri(ontology: Column, term: Column) -> Column:
    """The IRI of a term; an unknown ontology stays as `ontology:term`."""
    base = None
    for name, iri in BASES.items():
        base = F.when(ontology == name, F.lit(iri)) if base is None else base.when(ontology == name, F.lit(iri))
    return F.concat(base.otherwise(F.concat(ontology, F.lit(":"))), term)


def context(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Context entries `(type, id, fields)` of aligned types.

    `types` is `(type, place, ontology, term)`, one row per type alignment, and `fields` is
    `(type, place, field, ontology, term)`. The first type alignment names the type; a type
    with aligned fields only keeps its bare name; others have no entry. `fields` of the result
    is a map as wide as the type is.
    """
    named = types.groupBy("type").agg(
        F.min_by(alignment_iri(F.col("ontology"), F.col("term")), "place").alias("iri")
    )
    mapped = fields.groupBy("type").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct("place", "field", alignment_iri(F.col("ontology"), F.col("term")).alias("iri"))
                    )
                ),
                lambda x: F.struct(x["field"], x["iri"]),
            )
        ).alias("fields")
    )
    return named.join(mapped, "type", "full_outer").select(
        "type", F.coalesce("iri", "type").alias("id"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields")
    )


def graph(envelopes: DataFrame) -> DataFrame:
    """One JSON object per record: `@type`, `_id`, then the fields as they are."""
    head = F.concat(F.lit('{"@type":'), F.to_json(F.array("_type")), F.lit(',"_id":'), F.to_json(F.array("_id")))
    plain = F.regexp_replace(head, r"\[(\"(?:[^\"\\]|\\.)*\")\]", "$1")
    rest = F.when(F.col("fields") == "{}", F.lit("}")).otherwise(
        F.concat(F.lit(","), F.substr("fields", F.lit(2)))
    )
    return envelopes.select("_order", F.concat(plain, rest).alias("node"))


def alignments_of_pins(pins: DataFrame, type_versions: DataFrame) -> DataFrame:
    """Alignment rows of pinned type versions; pins of unknown versions are left out."""
    return pins.join(type_versions, ["author", "name", "version"])
