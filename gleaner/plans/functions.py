"""Scalar functions, over whole columns of the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gleaner.functions import number, registry, text, value
from gleaner.plans import query

SIZE = r"([0-9.]+) ?(g|oz)?"


@query("toString", "SELECT l_orderkey, l_linenumber, CAST(l_quantity::BIGINT AS VARCHAR) AS q, regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS d FROM lineitem")
def to_string(t):
    printed = lambda c: registry.pipe(F.col(c), [("toString",)], on=t.lineitem)
    return t.lineitem.select("l_orderkey", "l_linenumber", printed("l_quantity").alias("q"), printed("l_discount").alias("d"))


@query("lower", "SELECT doc_id, lower(text) AS s FROM documents")
def lower(t):
    return t.documents.select("doc_id", text.lower(F.col("text")).alias("s"))


@query("upper", "SELECT c_custkey, upper(c_name) AS s FROM customer")
def upper(t):
    return t.customer.select("c_custkey", text.upper(F.col("c_name")).alias("s"))


@query("lowercase", "SELECT c_custkey, lower(c_mktsegment) AS s FROM customer")
def lowercase(t):
    return t.customer.select("c_custkey", registry.pipe(F.col("c_mktsegment"), [("lowercase",)]).alias("s"))


# The capital of a sharp s is SS; the twin's `upper` keeps it one letter.
@query("uppercase", "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS s FROM documents")
def uppercase(t):
    return t.documents.select("doc_id", registry.pipe(F.col("text"), [("uppercase",)]).alias("s"))


@query("trim", r"SELECT doc_id, regexp_replace(regexp_replace(chr(160) || chr(10) || text || ' ' || chr(9), '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') AS s FROM documents")
def trim(t):
    padded = F.concat(F.lit(" \n"), "text", F.lit(" \t"))
    return t.documents.select("doc_id", text.trim(padded).alias("s"))


@query("capitalize", "SELECT p_partkey, upper(p_name[1]) || substr(p_name, 2) AS s FROM part")
def capitalize(t):
    return t.part.select("p_partkey", text.capitalize(F.col("p_name")).alias("s"))


@query(
    "titleCase",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '),
      lambda w: upper(w[1]) || lower(substr(w, 2))), ' ') AS s FROM part""",
)
def title_case(t):
    return t.part.select("p_partkey", text.title_case(F.concat(F.lit("  "), "p_name", F.lit(" \n "), "p_type")).alias("s"))


@query("replace", "SELECT doc_id, replace(text, 'the', 'THE') AS s FROM documents")
def replace(t):
    return t.documents.select("doc_id", text.replace(F.col("text"), "the", "THE").alias("s"))


@query("split", "SELECT doc_id, len(string_split(text, '. ')) AS n, array_to_string(string_split(text, '. '), '|') AS s FROM documents")
def split(t):
    parts = text.split(F.col("text"), ". ")
    return t.documents.select("doc_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("s"))


@query(
    "match",
    r"""SELECT doc_id, regexp_matches(text, '([A-Z][a-z]+)(, [a-z]+)?') AS matched,
      CASE WHEN regexp_matches(text, '([A-Z][a-z]+)(, [a-z]+)?') THEN regexp_extract(text, '([A-Z][a-z]+)(, [a-z]+)?', 1) END AS first,
      nullif(regexp_extract(text, '([A-Z][a-z]+)(, [a-z]+)?', 2), '') AS second FROM documents""",
)
def match(t):
    m = registry.pipe(F.col("text"), [("match", r"(?P<first>[A-Z][a-z]+)(?<second_one>, [a-z]+)?")], on=t.documents)
    return t.documents.select("doc_id", m.alias("m")).select(
        "doc_id", "m.matched", value.at(F.col("m.captures"), 1).alias("first"), value.at(F.col("m.captures"), 2).alias("second")
    )


@query("matches", r"SELECT doc_id, regexp_matches(text, '\bth[a-z]*\b') AS hit FROM documents")
def matches(t):
    return t.documents.select("doc_id", text.matches(F.col("text"), r"\bth[a-z]*\b").alias("hit"))


@query("replaceAll", r"SELECT doc_id, regexp_replace(text, '([a-z])([A-Z])', '\1_\2', 'g') AS s FROM documents")
def replace_all(t):
    return t.documents.select("doc_id", text.replace_all(F.col("text"), "([a-z])([A-Z])", "$1_$2").alias("s"))


@query("parseInt", r"SELECT doc_id, n_chars AS n, n_chars // 4 AS quarter, TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS BIGINT) AS found FROM documents")
def parse_int(t):
    padded = F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit("\n"))
    quarter = registry.pipe(F.col("n_chars") / 4, [("parseInt",)], on=t.documents)
    # Digits beyond a long are no number to the lenient form.
    found = number.parse_int(F.regexp_extract("text", r"(\d+)", 1), strict=False)
    return t.documents.select("doc_id", number.parse_int(padded).alias("n"), quarter.alias("quarter"), found.alias("found"))


@query("parseFloat", "SELECT c_custkey, c_acctbal AS x, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS y FROM customer")
def parse_float(t):
    s = F.col("c_acctbal").cast("string")
    odd = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(s, F.lit("d"))).otherwise(s)
    return t.customer.select("c_custkey", number.parse_float(s).alias("x"), number.parse_float(odd, strict=False).alias("y"))


@query("parseBool", "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels")
def parse_bool(t):
    word = F.when(F.col("toxic") == 1, F.lit(" Yes")).otherwise(F.lit("FALSE "))
    return t.labels.select(
        "doc_id", number.parse_bool(F.col("quality").cast("string")).alias("quality"), number.parse_bool(word).alias("toxic")
    )


@query("length", "SELECT d.doc_id, length(text) AS chars, len(string_split(text, ' ')) AS words, coalesce(length(CAST(quality AS VARCHAR)), 0) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def length(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        registry.pipe(F.col("text"), [("length",)], on=t.documents).cast("long").alias("chars"),
        registry.pipe(F.col("text"), [("split", " "), ("length",)], on=t.documents).cast("long").alias("words"),
        value.length_of_text(F.col("quality").cast("string")).cast("long").alias("q"),
    )


@query(
    "dedup",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
      f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
    SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id""",
)
def dedup(t):
    words = value.dedup(F.split("text", " ", -1))
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n"), F.array_join(words, " ").alias("words"))


@query("first", "SELECT doc_id, text[1] AS c, string_split(text, ' ')[1] AS w FROM documents")
def first(t):
    return t.documents.select(
        "doc_id",
        registry.pipe(F.col("text"), [("first",)], on=t.documents).alias("c"),
        registry.pipe(F.col("text"), [("split", " "), ("first",)], on=t.documents).alias("w"),
    )


@query("coalesce", "SELECT d.doc_id, coalesce(toxic, quality, 9) AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coalesce(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", value.coalesce(F.col("toxic"), F.col("quality"), F.lit(9)).alias("v")
    )


@query("default", "SELECT d.doc_id, coalesce(quality, 0) AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def default(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", value.default(F.col("quality"), F.lit(0)).alias("v"))


@query("getField", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS gone FROM events")
def get_field(t):
    return t.events.select(
        "event_id", value.get_field(F.col("props"), "k").alias("k"), value.get_field(F.col("props"), "gone").alias("gone")
    )


@query("parseJson", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS typed FROM events")
def parse_json(t):
    return t.events.select(
        "event_id",
        F.try_variant_get(value.parse_json(F.col("props")), "$.k", "bigint").alias("k"),
        value.parse_json(F.col("props"), "k long")["k"].alias("typed"),
    )


@query("fn_user", r"""SELECT p_partkey, CAST(regexp_extract(s, '([0-9.]+) ?(g|oz)?', 1) AS DOUBLE) AS amount, nullif(regexp_extract(s, '([0-9.]+) ?(g|oz)?', 2), '') AS unit
    FROM (SELECT p_partkey, p_size || CASE p_type WHEN 'PROMO' THEN ' g' WHEN 'SMALL' THEN ' oz' ELSE '' END AS s FROM part)""")
def fn_user(t):
    def size_parts(label):
        """A job's own function: columns in, columns out; it sees only its parameters."""
        caught = text.match(label, SIZE)["captures"]
        return number.parse_float(value.at(caught, 1)).alias("amount"), value.at(caught, 2).alias("unit")

    label = F.concat("p_size", value.case_of(F.col("p_type"), {"PROMO": F.lit(" g"), "SMALL": F.lit(" oz")}, F.lit("")))
    return t.part.select("p_partkey", *size_parts(label))


@query("fn_pipe", "SELECT p_partkey, '<' || upper(p_name) || '>' AS s FROM part")
def fn_pipe(t):
    own = registry.register("wrap", lambda c, a, b: F.concat(F.lit(a), c, F.lit(b)))
    return t.part.select("p_partkey", registry.pipe(F.col("p_name"), [("upper",), ("wrap", "<", ">")], own).alias("s"))


@query("fn_register", "SELECT p_partkey, reverse(p_name) AS s FROM part")
def fn_register(t):
    @F.pandas_udf("string")
    def backwards(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    own = registry.register("backwards", backwards)
    return t.part.select("p_partkey", registry.pipe(F.col("p_name"), [("backwards",)], own).alias("s"))
