"""Entity look-up: flatten claims to one value per property, once per entity, then join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Only the parts the flattening reads; the JSON scan skips the rest.
ENTITY = (
    "missing string, labels map<string,struct<value: string>>, descriptions map<string,struct<value: string>>, "
    "claims map<string,array<struct<mainsnak: struct<snaktype: string, datatype: string, datavalue: struct<value: string>>>>>"
)

# How the datatypes of the entity format are read.
AS_TEXT = ("string", "external-id", "commonsMedia", "url", "math", "musical-notation", "geo-shape", "tabular-data")
AS_ID = ("wikibase-item", "wikibase-property", "wikibase-lexeme", "wikibase-form", "wikibase-sense")
AS_KEY = {"time": "time", "quantity": "amount", "monolingualtext": "text"}


def en_label(entity: Column) -> Column:
    return F.try_element_at(entity["labels"], F.lit("en"))["value"]


def en_description(entity: Column) -> Column:
    return F.try_element_at(entity["descriptions"], F.lit("en"))["value"]


def flat_value(datatype: Column, value: Column) -> Column:
    """One string for a claim value, by its datatype; `value` is text or JSON text."""
    out = F.when(datatype.isin(*AS_TEXT), value).when(datatype.isin(*AS_ID), F.get_json_object(value, "$.id"))
    for name, key in AS_KEY.items():
        out = out.when(datatype == name, F.get_json_object(value, f"$.{key}"))
    lat, lon = F.get_json_object(value, "$.latitude"), F.get_json_object(value, "$.longitude")
    return out.when(datatype == "globe-coordinate", F.concat(lat, F.lit(","), lon)).otherwise(value)


def flat_claims(entity: Column) -> Column:
    """Map of property to the value of its first claim; a claim that says "no value" gives null."""

    def first(_, claims: Column) -> Column:
        snak = F.get(claims, F.lit(0))["mainsnak"]
        usable = F.coalesce(snak["snaktype"], F.lit("value")) == "value"
        return F.when(usable, flat_value(F.coalesce(snak["datatype"], F.lit("")), snak["datavalue"]["value"]))

    listed = F.map_filter(entity["claims"], lambda _, claims: F.size(claims) > 0)
    return F.transform_values(listed, first)


def entities(payloads: DataFrame, key: str, json: str) -> DataFrame:
    """Entity table `(key, label, description, claims, missing)` from JSON payloads."""
    e = F.from_json(json, ENTITY)
    return payloads.select(F.col(key).alias("key"), e.alias("e")).select(
        "key",
        en_label(F.col("e")).alias("label"),
        en_description(F.col("e")).alias("description"),
        flat_claims(F.col("e")).alias("claims"),
        F.col("e.missing").isNotNull().alias("missing"),
    )


def from_responses(captures: DataFrame, body: str = "body") -> DataFrame:
    """Entity payloads `(key, json)` out of recorded responses `{"entities": {key: {...}}}`."""
    found = F.from_json(body, "entities map<string,string>")["entities"]
    return captures.select(F.explode(found).alias("key", "json"))


def enrich(records: DataFrame, key: str, table: DataFrame, properties: dict[str, str], strict: bool = False) -> DataFrame:
    """Records with the wanted properties of their entity, all from one join.

    Strict raises on a null key and on an absent or deleted entity; otherwise these rows carry
    the reason in `enrich_error`. A record without a claim gets null.
    """
    side = table.select(
        F.col("key").alias("__key"),
        F.col("missing").alias("__missing"),
        F.col("label").alias("entity_label"),
        *[F.try_element_at("claims", F.lit(p)).alias(n) for n, p in properties.items()],
    )
    out = records.join(side, F.col(key) == F.col("__key"), "left").withColumn(
        "enrich_error",
        F.when(F.col(key).isNull(), F.lit("key is null"))
        .when(F.col("__key").isNull(), F.lit("entity not present"))
        .when(F.col("__missing"), F.lit("entity is missing")),
    )
    if strict:
        out = out.withColumn(
            "enrich_error",
            F.when(F.col("enrich_error").isNotNull(), F.raise_error(F.col("enrich_error"))).otherwise(
                F.col("enrich_error")
            ),
        )
    return out.drop("__key", "__missing")
