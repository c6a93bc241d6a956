"""Each operator bound to the driver tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import binary, bpe, chat, jaccard, packing, pii, quality, repair, sharding, toxicity, urls, whiten, winnow
from gleaner.session import new_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


# Perspectives of every dialogue. Turn pieces are numbered by a running sum, as in the operator.
CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
parties AS (SELECT DISTINCT conv_id, name AS perspective FROM said WHERE name <> 'system'),
heads AS (
  SELECT s.conv_id, perspective, turn, name, said, name = perspective AS own,
    CASE WHEN name = 'system' THEN '<|im_start|>system' WHEN name = perspective THEN '<|im_start|>assistant'
      ELSE '<|im_start|>user name=' || replace(translate(name, chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(8232) || chr(8233), '       '), '<|', '< |') END || chr(10) AS head
  FROM said s JOIN parties p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
pieces AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS piece,
    coalesce(sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, said
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM heads),
parts AS (SELECT *, start // 65536 AS part FROM pieces),
firsts AS (SELECT *, min(start) OVER (PARTITION BY conv_id, perspective, part) AS first FROM parts)
SELECT conv_id, perspective, part, first AS start, string_agg(piece, '' ORDER BY start, piece) AS text, count(*) AS n_turns,
  coalesce(string_agg(CASE WHEN own THEN (start - first + length(head))::VARCHAR || '-' || (start - first + length(piece) - 1)::VARCHAR END,
    ',' ORDER BY start, piece), '') AS loss
FROM firsts GROUP BY conv_id, perspective, part, first
"""


@query("op1_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, path: str) -> DataFrame:
    """Every dialogue in the eyes of each speaker, with the spans that bear loss as text. A rendering of more than
    65,536 code points comes in several rows, cut between turns and numbered by `part`."""
    out = chat.rendered(chat.rotated(spark.read.parquet(f"{path}/conversations.parquet")))
    spans = F.transform("loss", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("loss", F.array_join(spans, ","))


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i AS pos, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(5, pos - coalesce(prev, -9)))::BIGINT AS n
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM again) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals
  FROM w LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * word_chars < 5 * n_words
    OR word_chars > 12 * n_words OR 100 * letters < 45 * word_chars OR 100 * capitals > 60 * letters) AS kept
FROM b
"""


@query("op3_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, path: str) -> DataFrame:
    """Measures of every document; what the base leaves goes through the cascade, in the order that a sample gives."""
    docs = documents(spark, path).select("doc_id", "text")
    sample = stored(quality.measured(quality.sample_of(docs)), "sample")
    rules = quality.ordered(sample, quality.text_rules(have=quality.measures()))
    m = quality.measured(docs)
    m = m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(quality.cascade(rules).isNull())
    return m.withColumn("kept", kept).drop("text", "n_lines")


# crc32 by the byte, over a table that its rule gives.
CRC_SQL = """
WITH RECURSIVE steps(k, v, i) AS (
  SELECT k, k::BIGINT, 0 FROM range(256) r(k)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM steps WHERE i = 8),
"""
SHARD_SQL = (
    CRC_SQL
    + """d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
e AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc),
u AS (
  SELECT e.*, s, (('0x' || substr(md5(s::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM e, range(9) r(s)),
f AS (
  SELECT doc_id, size, text_crc32, arg_max(s, u) FILTER (s < 8) AS shard, arg_max(s, u) AS grown FROM u
  GROUP BY doc_id, size, text_crc32)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM f
"""
)


@query("op5_sharding", SHARD_SQL)
def shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents in eight equal shards by doc_id, and where they go with a ninth."""
    docs = documents(spark, path)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = sharding.assign(rows, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    out = sharding.numbered(out, "shard", "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Rows of a document's pieces come from one pass over the texts; digests are taken of the ids it returns.
@query("op2_packing")
def packed(spark: SparkSession, path: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids, cut where a sequence is full."""
    return pieces(documents(spark, path))


def pieces(docs: DataFrame) -> DataFrame:
    out = packing.pack_texts(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"), [2])
    crc = F.crc32("ids").alias("ids_crc32")
    return out.select(F.col("key").alias("doc_id"), "start", "length", crc, "doc_tokens", "sequence_id", "offset", "segment")


@query("op8_token_output")
def token_output(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all documents written to Simple-8b frames in order of doc_id, and read back from them."""
    to = new_path(spark, "tokens")
    binary.write_tokens(documents(spark, path), "doc_id", "text", vocabulary("byte_bpe_50k.json"), [0], to)
    back = binary.read_tokens(spark, to, F.crc32("ids").alias("ids_crc32"))
    return back.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    """Ids of every text by the rank file, and the bytes they decode to, as digests."""
    columns = {
        "n_tokens": (T.LongType(), lambda ids, back: len(ids)),
        "ids_sha256": (T.StringType(), lambda ids, back: hashlib.sha256(ids.tobytes()).hexdigest()),
        "decoded_sha256": (T.StringType(), lambda ids, back: hashlib.sha256(back).hexdigest()),
    }
    rows = documents(spark, path).select("doc_id", "text")
    return bpe.transcoded(rows, "text", vocabulary("byte_bpe_50k.tiktoken"), columns).drop("text")


@query("op9_winnowing")
def fingerprinted(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms; the strings are the chosen hashes in order, in hex."""
    out = winnow.compared(documents(spark, path), "doc_id", "text")
    return out.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("hashes")).alias("fingerprint"),
        F.lower(F.hex("edited_hashes")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.y)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.x = w.doc_id GROUP BY w.doc_id, n.n
"""


@query("op10_ngram_jaccard", NEAR_SQL)
def near_copies(spark: SparkSession, path: str) -> DataFrame:
    """Every document's component of near copies: five-word shingles, similarity of 0.75 or more."""
    return jaccard.near_duplicates(documents(spark, path)).withColumnRenamed("id", "doc_id")


TOXIC_FROM = 0.3


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def toxicity_model(docs: DataFrame, spark: SparkSession, path: str) -> toxicity.Model:
    labels = spark.read.parquet(f"{path}/labels.parquet")
    return toxicity.fit(docs, labels, "doc_id", "text", "toxic", ~held_out())


@query("op6_toxicity")
def toxic_scores(spark: SparkSession, path: str) -> DataFrame:
    """Every document's toxicity; labels of the held-out fold are not read into the fit."""
    docs = documents(spark, path).select("doc_id", "text")
    out = toxicity.scored(docs, "text", toxicity_model(docs, spark, path))
    predicted = (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", predicted)


# Stands for the secret that a real run takes from its own settings.
PII_KEY = b"example key of the test tables"


@query("op7_pii")
def private_data(spark: SparkSession, path: str) -> DataFrame:
    """Every document with pseudonyms for its personal numbers, dates and mail names, and where they are."""
    out = pii.pseudonymised(documents(spark, path).select("doc_id", "text"), "text", PII_KEY)
    return out.withColumn("n_replaced", F.coalesce(F.size("spans"), F.lit(0)).cast("long"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations as a bad export would leave them: what happens to a row hangs on the checksum of its place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
        .where(F.col("_kind") != 0)
        .withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
        .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def _repair_sql() -> str:
    """The same decision from the first row to the last: for each state a string of eight digits of cost and the letters."""

    def then(path: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({path}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({path}, 9) || '{letter}')"

    def new_rows(s: list[str]) -> list[str]:
        i = [then(x, "5", "I") for x in s]
        return [s[0], s[1], f"least({s[2]}, {i[0]}, {i[1]}, {i[3]})", f"least({s[3]}, {i[2]})"]

    a, b, v = ([f"{x}{k}" for k in range(4)] for x in "abv")
    late, some = "(code = upper(code) AND code <> '-')::INT * 5", "code <> '-'"
    keep = lambda s, r: f"CASE WHEN lower(code) = '{r}' THEN {then(s, late, 'K')} END"
    role = lambda s, r: f"CASE WHEN {some} AND lower(code) <> '{r}' THEN {then(s, late + ' + 1', 'R')} END"
    go = lambda s: then(s, "2", "D")
    to_user = [f(s, "u") for s in (v[0], v[1], v[3]) for f in (keep, role)]
    after = [go(v[0]), f"least({go(v[1])}, {keep(v[0], 's')})", f"least({go(v[2])}, {', '.join(to_user)})", f"least({go(v[3])}, {keep(v[2], 'a')}, {role(v[2], 'a')})"]
    listed = lambda xs, names: ", ".join(f"{x} AS {n}" for x, n in zip(xs, names))
    return (
        CRC_SQL
        + f"""raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
      lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM raw, crc),
left_over AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), sha256(text)) AS n FROM left_over),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair, n > 1 AS has_pair
  FROM ordered),
coded AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(c) ELSE c END AS code
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS c FROM faults)),
told AS (
  SELECT conv_id, string_agg(code, '' ORDER BY n) AS codes, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (has_pair AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM coded GROUP BY conv_id),
walk(conv_id, codes, i, a0, a1, a2, a3) AS (
  SELECT conv_id, codes, 0, '00000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM told
  UNION ALL
  SELECT conv_id, codes, i + 1, {', '.join(after)}
  FROM (
    SELECT *, substr(codes, (i + 1)::BIGINT, 1) AS code, {listed(new_rows(b), v)}
    FROM (SELECT *, {listed(new_rows(a), b)} FROM walk WHERE i < length(codes)))),
ended AS (
  SELECT conv_id, least(v0, v3) AS best
  FROM (SELECT *, {listed(new_rows(b), v)} FROM (SELECT *, {listed(new_rows(a), b)} FROM walk WHERE i = length(codes)))),
audits AS (SELECT conv_id, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM ended),
letters AS (
  SELECT conv_id, j, audit[j] AS x, sum((audit[j] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS row
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits)),
stay AS (
  SELECT l.conv_id, x, c.role, CASE WHEN x = 'I' THEN '' ELSE c.text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) AS k,
    first_value(x = 'K' AND c.initial = 's') OVER (PARTITION BY l.conv_id ORDER BY j) AS led
  FROM letters l LEFT JOIN coded c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.row = c.n AND x <> 'I' WHERE x <> 'D'),
pieces AS (
  SELECT conv_id, k, CASE WHEN x = 'K' THEN role WHEN (k - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS piece FROM stay),
whole AS (SELECT conv_id, string_agg(piece, chr(10) ORDER BY k) AS text FROM pieces GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(w.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN told t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN audits a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN whole w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
"""
    )


@query("op11_conversation_repair", _repair_sql())
def conversation_repair(spark: SparkSession, path: str) -> DataFrame:
    """Every conversation after damage: what is wrong with it, the cheapest edits, and a digest of the repaired text."""
    turns = spark.read.parquet(f"{path}/conversations.parquet")
    return repair_report(turns)


def repair_report(turns: DataFrame) -> DataFrame:
    done = repair.repaired(damaged(turns))
    pieces = done.turns.select("conv_id", "seq", F.concat("role", F.lit(":"), "text").alias("piece"))
    texts = repair.digests(pieces, "conv_id", "seq", "piece").withColumnRenamed("conv_id", "_of")
    found = done.conversations.withColumnRenamed("conv_id", "_conv")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        turns.select("conv_id").distinct()
        .join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .join(texts, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
        .select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    )


# Rules as they are written: action, then host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
DESCENT = {"steps": 400, "rate": 8.0, "ridge": 1e-5}


def _url_sql() -> str:
    """The regression in its dual form by a recursion over steps; rules as a table."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({text(a)}, {text(w)})" for a, w in URL_RULES)
    table = ", ".join(f"({text(u)}, {k})" for u, k in urls.LABELLED)
    part = lambda s, mark: "list_concat(" + "), list_concat(".join(
        f"list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: '{mark}' || substr({s}, i, {n}))" for n in urls.SIZES
    ).replace("), list_concat(", ", list_concat(", 1) + "))"
    steps, rate, ridge = DESCENT["steps"], DESCENT["rate"], DESCENT["ridge"]
    return f"""
WITH RECURSIVE split AS (
  SELECT page_id, url, -1.0 AS label FROM pages UNION ALL SELECT NULL, url, label FROM (VALUES {table}) t(url, label)),
named AS (
  SELECT *, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM split),
grams AS (
  SELECT *, {part("('^' || host || '$')", "h")} AS hg, {part("path", "p")} AS pg FROM named),
buckets AS (
  SELECT page_id, label, host, path, list_distinct(list_transform(list_concat(hg, pg), lambda g: ('0x' || substr(md5(g), 1, 4))::INTEGER)) AS f
  FROM grams),
facts AS MATERIALIZED (SELECT *, sqrt(greatest(len(f), 1)::DOUBLE) AS n FROM buckets),
learn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY label, n, f) AS i, label::DOUBLE AS y, n, list_sort(f) AS f FROM facts WHERE label >= 0),
kernel AS (
  SELECT a.i, list(1 + len(list_intersect(a.f, b.f)) / (a.n * b.n) ORDER BY b.i) AS row FROM learn a, learn b GROUP BY a.i),
known AS MATERIALIZED (SELECT list(row ORDER BY i) AS k, (SELECT list(y ORDER BY i) FROM learn) AS y, count(*) AS m FROM kernel),
descent(step, a) AS (
  SELECT 0, (SELECT list(0.0::DOUBLE) FROM learn)
  UNION ALL
  SELECT step + 1, list_transform(list_zip(k, a, y), lambda x: x[2] * (1 - {rate} * {ridge})::DOUBLE
    + ({rate}::DOUBLE / m) * (x[3] - 1 / (1 + exp(-list_dot_product(x[1], a)))))
  FROM descent, known WHERE step < {steps}),
dual AS MATERIALIZED (SELECT i, f, n, a[i] AS a FROM learn, (SELECT a FROM descent WHERE step = {steps})),
weights AS (SELECT b, sum(a / n) AS w FROM (SELECT unnest(f) AS b, a, n FROM dual) GROUP BY b),
asked AS (SELECT row_number() OVER () AS q, * FROM facts WHERE label < 0),
margins AS (
  SELECT q, sum(w) AS total FROM (SELECT q, unnest(f) AS b FROM asked) JOIN weights USING (b) GROUP BY q),
fitting AS (
  SELECT q, arg_min(where_, place) AS rule, arg_min(action, place) AS action
  FROM asked, (SELECT action, where_, split_part(where_, '/', 1) AS name, substr(where_, position('/' IN where_)) AS rest,
      row_number() OVER (ORDER BY length(where_) DESC, length(split_part(where_, '/', 1)) DESC, action DESC) AS place
    FROM (VALUES {rules}) r(action, where_))
  WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, rest) GROUP BY q)
SELECT page_id, host, path, rule, coalesce(action,
  CASE WHEN (SELECT sum(a) FROM dual) + coalesce(total, 0) / n > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM asked LEFT JOIN margins USING (q) LEFT JOIN fitting USING (q)
"""


@query("op12_url_filters", _url_sql())
def url_filters(spark: SparkSession, path: str) -> DataFrame:
    """Every page's host and path, the longest rule that fits, and what it or the regression says."""
    model = urls.fit(urls.labelled_table(spark), **DESCENT)
    pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url")
    out = urls.judged(pages, "url", [urls.Rule(a, w) for a, w in URL_RULES], model)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, path: str) -> DataFrame:
    """Every kept vector by component, whitened; identity error and shares of variance beside it."""
    rows, model, error = whiten.whitened(spark.read.parquet(f"{path}/embeddings.parquet"), "vec_id", "embedding")
    share = F.lit(model.explained).cast("array<double>")
    return rows.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        # Null where the sum of squares is beyond 64 bits; the operator has it as a decimal.
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
