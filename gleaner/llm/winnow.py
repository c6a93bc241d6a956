"""Winnowing: document fingerprints from rolling k-gram hashes.

Every k code points have a hash; of every w neighbouring hashes the least is chosen, the rightmost of equals, with its
place. Two texts that share k + w - 1 code points or more share a chosen hash: any window of w hashes within the
shared stretch chooses alike in both. The expected share of places chosen is 2 / (w + 1).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tokens import batched, texts_of

BLOCK_BYTES = 32 << 20
K, W = 8, 8  # any 15 shared code points are found, so a text of 30 always meets its half-kept edit
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of the k code points from each place on; the last k - 1 are of no use.

    A polynomial hash put together from halves: that of 2m points from two of m.
    """
    power = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    power ^= power >> np.uint64(29)
    power *= _MIX
    out, have, base, factor = None, 0, power, _BASE
    rest, size = k, 1
    while rest:
        if rest & 1:
            if out is None:
                out, have = base, size
            else:  # the part of `size` points comes after the `have` that are there
                out = out * factor
                out[: len(out) - have] += base[have:]
                have += size
        rest >>= 1
        if rest:
            nxt = base * factor
            nxt[: len(nxt) - size] += base[size:]
            base, factor, size = nxt, factor * factor, size * 2
    out = out ^ (out >> np.uint64(32))
    out *= _MIX
    return out >> np.uint64(32)


def winnow(texts: Sequence[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chosen hashes and their places (both unsigned 32-bit, in order of place) of each text.

    A text shorter than k counts as one k-gram, one with fewer than w k-grams as one window; an empty text has none.
    """
    with np.errstate(over="ignore"):
        sizes = np.array([len(t) for t in texts], np.int64)
        # Short texts are filled up to one k-gram.
        points = np.frombuffer("".join(t if len(t) >= k else t.ljust(k, "\0") for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        room = np.where(sizes > 0, np.maximum(sizes, k), 0)
        begins = np.cumsum(room) - room
        grams = np.where(sizes > 0, room - k + 1, 0)
        if not len(points):
            return [(np.zeros(0, np.uint32), np.zeros(0, np.uint32)) for _ in texts]
        place = np.arange(len(points), dtype=np.uint64) - np.repeat(begins, room).astype(np.uint64)
        # The least key is the least hash and, among equals, the last place.
        key = (_rolling(points, k) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place)
        least, m = key.copy(), 1
        while 2 * m <= w:
            np.minimum(least[:-m], least[m:], out=least[:-m])
            m *= 2
        if w > m:
            shift = w - m
            least = np.minimum(least[: len(least) - shift], least[shift:]) if len(least) > shift else least[:0]
        out = []
        for b, g in zip(begins.tolist(), grams.tolist()):
            if g == 0:
                got = key[:0]
            elif g <= w:
                got = key[b : b + g].min(keepdims=True)
            else:
                got = least[b : b + g - w + 1]
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
            out.append(((got >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (got & np.uint64(0xFFFFFFFF))).astype(np.uint32)))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct hashes of two fingerprints; two empty ones are alike."""
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def fingerprints(docs: DataFrame, text: str, k: int = K, w: int = W, hashes: str = "hashes", places: str = "places") -> DataFrame:
    """Add the fingerprint of a text: chosen hashes and their places, little-endian 32-bit in binary.

    A null text is an empty one and has none. Rows are taken alone: no shuffle, and equal texts have equal
    fingerprints. Other columns are kept; the new names must be free.
    """
    if clash := {hashes, places} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            got = winnow(texts_of(b.column(at)), k, w)
            cols = [pa.array([x[j].astype("<u4").tobytes() for x in got], pa.binary()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, hashes, places])

    new = [T.StructField(n, T.BinaryType()) for n in (hashes, places)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def chained(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Deal rows so that a task meets each row before the next one, descending by key: columns key, text, block, more.

    Rows go to blocks by quantiles of the key. The first row of a block is also sent to the block above, with
    `more` = 1, to follow that one's last row; the first row of all follows the last. The keys of those rows are
    the only thing the driver holds, one for each block. There are two blocks for each shuffle partition, or more where
    that would make them larger than BLOCK_BYTES of text. Rows come sorted. Keys are numbers. Null keys come last; rows of one key go by their text, and are one block's work.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BLOCK_BYTES)))
    n = 2 * tasks
    place = F.coalesce(F.col("key").cast("double"), F.lit(-math.inf))
    cuts = docs.select(F.col("key").cast("double").alias("p")).approxQuantile("p", [i / n for i in range(1, n)], 0.1 / n)
    docs = docs.withColumn("_place", place)
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    docs = Bucketizer(splits=splits, inputCol="_place", outputCol="_block").transform(docs).withColumn("block", F.col("_block").cast("int")).drop("_place", "_block")
    tops = sorted(docs.groupBy("block").agg(F.max("key").alias("top")).collect(), key=lambda r: -r["block"])
    pairs = [(below["top"], here["block"]) for here, below in zip(tops, tops[1:] + tops[:1])]
    heads = spark.createDataFrame(pairs, T.StructType([T.StructField("_top", docs.schema["key"].dataType), T.StructField("_to", T.IntegerType())]))
    dealt = F.array_compact(
        F.array(F.struct("block", F.lit(0).alias("more")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("block"), F.lit(1).alias("more"))))
    )
    out = docs.join(F.broadcast(heads), F.col("key").eqNullSafe(F.col("_top")), "left").select("key", "text", F.explode(dealt).alias("at"))
    out = out.select("key", "text", "at.block", "at.more").repartition(tasks, "block")
    return out.sortWithinPartitions("block", "more", F.col("key").desc_nulls_last(), "text")


def edited_text(text: str, nxt: str) -> str:
    """The last half of a text, rounded down, replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


COMPARED = "key {key}, n_chars long, edited_sha256 string, hashes binary, places binary, edited_hashes binary, near_edited double, near_next double"


def compared(docs: DataFrame, key: str, text: str, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and its edited form, and their likeness to each other and to the next text's.

    Next is the row below in descending order of key, and the first after the last (a single row follows itself).
    See `chained` for the order of nulls and ties. Null texts are empty; an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its next one: key, text, block
        for b in batched(batches):
            rows = zip(b.column("key").to_pylist(), texts_of(b.column("text")), b.column("block").to_pylist(), b.column("more").to_pylist())
            pairs = []
            for value, t, block, more in rows:
                if last is not None and last[2] == block:
                    pairs.append((last[0], last[1], t))
                last = None if more else (value, t, block)
            if pairs:
                yield _compared(pairs, b.schema.field("key").type, k, w)

    return chained(docs, key, text).mapInArrow(run, COMPARED.format(key=kind))


def _compared(pairs: list[tuple], key: pa.DataType, k: int, w: int) -> pa.RecordBatch:
    texts = [t for _, t, _ in pairs]
    edited = [edited_text(t, n) for _, t, n in pairs]
    # A row's next text is mostly the row after it here: each text is fingerprinted once.
    follow = [n for (_, _, n), t in zip(pairs, texts[1:] + [None]) if n is not t]
    got = winnow(texts + edited + follow, k, w)
    own, changed, rest = got[: len(texts)], got[len(texts) : 2 * len(texts)], iter(got[2 * len(texts) :])
    after = [own[i + 1] if i + 1 < len(pairs) and pairs[i][2] is texts[i + 1] else next(rest) for i in range(len(pairs))]
    raw = lambda x: x.astype("<u4").tobytes()
    cols = [
        pa.array([p[0] for p in pairs], key),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array([raw(x[0]) for x in own], pa.binary()),
        pa.array([raw(x[1]) for x in own], pa.binary()),
        pa.array([raw(x[0]) for x in changed], pa.binary()),
        pa.array([likeness(x[0], y[0]) for x, y in zip(own, changed)], pa.float64()),
        pa.array([likeness(x[0], y[0]) for x, y in zip(own, after)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["key", "n_chars", "edited_sha256", "hashes", "places", "edited_hashes", "near_edited", "near_next"])
