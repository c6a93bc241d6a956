"""Token ids in Simple-8b words: many small numbers to a 64-bit word.

The top four bits of a word choose how many ids share the other sixty; each block of 1024 ids begins a new word, and
its place is kept, so blocks decode alone. An id too wide for sixty bits goes to a table at the end of the frame, its
word holds the place there. Encoding and decoding go over whole arrays: each step handles one word of all blocks, or
all words of one selector.

A frame is a file image of some documents: header, length of each document, first word of each block, words, wide
ids. Frames are rows of binary in a Parquet table, so that Spark commits them once however often a task is tried,
on any store it can write.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tokens import batched, file_encoder

MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQIII")  # magic, documents, ids, blocks, words, wide ids
BLOCK = 1024
# Selector k packs COUNTS[k] ids of 60 // COUNTS[k] bits; selector 0 is one place in the table of wide ids.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
WIDTHS = 60 // COUNTS
FRAME_IDS = 1 << 18


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 64-bit numbers."""
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, wide ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + int(COUNTS[-1])), np.uint64)
    need = np.full(grid.shape, 255, np.uint8)  # nothing fits beyond the end
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = np.full(blocks * BLOCK, 255, np.uint8)
    width[:n] = _bits(flat[:n])
    need[:, :BLOCK] = width.reshape(blocks, BLOCK)
    # The densest selector that fits at each place: what the next c ids need at most, c growing.
    best = (need[:, :BLOCK] <= 60).astype(np.uint8)
    most, c = need.copy(), 1
    for k in range(2, len(COUNTS)):
        while c < COUNTS[k]:
            np.maximum(most[:, :-c], need[:, c:], out=most[:, :-c])
            c += 1
        fits = most[:, :BLOCK] <= WIDTHS[k]
        if not fits.any():
            break
        best[fits] = k
    # One word of every block at a time.
    ends = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    begins = np.zeros((blocks, BLOCK), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        begins[row, at] = True
        at = at + COUNTS[best[row, at]]
        going = at < ends[row]
        row, at = row[going], at[going]
    rows, ats = np.nonzero(begins)
    sel = best[rows, ats]
    words = sel.astype(np.uint64) << np.uint64(60)
    for k in range(1, len(COUNTS)):
        of = np.nonzero(sel == k)[0]
        if len(of):
            r, a = rows[of], ats[of]
            w = words[of]
            for j in range(COUNTS[k]):
                w |= grid[r, a + j] << np.uint64(j * WIDTHS[k])
            words[of] = w
    of = np.nonzero(sel == 0)[0]
    words[of] |= np.arange(len(of), dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(begins.sum(axis=1))[:-1]]).astype(np.uint32)
    return words, first, grid[rows[of], ats[of]]


def unpack_words(words: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The ids of whole words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    for k in np.unique(sel):
        of = np.nonzero(sel == k)[0]
        w, b, mask = words[of], begins[of], np.uint64((1 << int(WIDTHS[k])) - 1)
        if k == 0:
            out[b] = wide[(w & mask).astype(np.int64)]
            continue
        for j in range(COUNTS[k]):
            out[b + j] = (w >> np.uint64(j * WIDTHS[k])) & mask
    return out


def frame(ids: np.ndarray, lengths: Sequence[int]) -> bytes:
    """The file image of some documents' ids, one after the other."""
    words, first, wide = pack_words(ids.astype(np.uint64))
    head = HEADER.pack(MAGIC, len(lengths), len(ids), len(first), len(words), len(wide))
    parts = np.array(lengths, "<u4"), first.astype("<u4"), words.astype("<u8"), wide.astype("<u8")
    return head + b"".join(p.tobytes() for p in parts)


def _parts(image: bytes):
    magic, docs, n, blocks, n_words, n_wide = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    at = HEADER.size
    out = []
    for count, kind in ((docs, "<u4"), (blocks, "<u4"), (n_words, "<u8"), (n_wide, "<u8")):
        out.append(np.frombuffer(image, kind, count, at))
        at += count * int(kind[2])
    return n, *out


def unframe(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a frame, and the length of each document."""
    n, lengths, _, words, wide = _parts(image)
    return unpack_words(words, wide)[:n], lengths


def read_blocks(image: bytes, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last, without decoding the others."""
    n, _, begins, words, wide = _parts(image)
    end = begins[last + 1] if last + 1 < len(begins) else len(words)
    return unpack_words(words[begins[first] : end], wide)


FRAMES = "keys array<{key}>, part int, frame int, n_ids long, image binary"


def _framed(batches, vocabulary: str, end: Sequence[int], frame_ids: int, key: pa.DataType):
    part, number = TaskContext.get().partitionId(), 0
    encode, tail = file_encoder(vocabulary, bare=False), np.array(end, "<u4").tobytes()
    keys, held, size = [], [], 0

    def out():
        ids = np.frombuffer(b"".join(held), "<u4")
        lengths = [len(h) // 4 for h in held]
        cols = [pa.array([keys], pa.list_(key)), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([frame(ids, lengths)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["keys", "part", "frame", "n_ids", "image"])

    for b in batched(batches):
        ids, at = encode(b.column(1))
        for k, first, last in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
            keys.append(k)
            held.append(ids[first:last].tobytes() + tail)
            size += len(held[-1]) // 4
            if size >= frame_ids:
                yield out()
                keys, held, size, number = [], [], 0, number + 1
    if keys:
        yield out()


def write_tokens(docs: DataFrame, key: str, text: str, vocabulary: str, end: Sequence[int], path: str, frame_ids: int = FRAME_IDS) -> None:
    """Encode texts and write frames in ascending order of key.

    Keys are dealt by range, each task sorts its own and writes one file; `part` and `frame` order the frames of
    all files. A frame ends with the document that fills it. A null text is empty and has its end; null keys come
    first; rows of one key go by their text; an empty table gives an empty one. Other columns are not read. A key is
    a bigint, an int or a string.
    """
    kind = docs.schema[key].dataType
    if kind.simpleString() not in ("bigint", "int", "string"):
        raise ValueError(f"no key of type {kind.simpleString()}")
    rows = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    out = rows.mapInArrow(lambda it: _framed(it, vocabulary, end, frame_ids, arrow), FRAMES.format(key=kind.simpleString()))
    out.write.option("compression", "zstd").parquet(path)


def _read(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            ids, lengths = unframe(b.column("image")[i].as_py())
            ids = ids.astype("<u4")
            ends = np.cumsum(lengths.astype(np.int64))
            n = len(lengths)
            cols = [b.column("keys")[i].values, pa.array(np.full(n, b.column("part")[i].as_py(), np.int32)), pa.array(np.full(n, b.column("frame")[i].as_py(), np.int32))]
            cols += [pa.array(ends - lengths), pa.array(lengths.astype(np.int64))]
            cols.append(pa.array([ids[e - k : e].tobytes() for k, e in zip(lengths, ends)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["key", "part", "frame", "within", "n_ids", "ids"])


def read_tokens(spark: SparkSession, path: str, value: Column | None = None) -> DataFrame:
    """The documents of written frames: key, start (ids of all documents before it), n_ids, ids (little-endian 32-bit).

    `value`: a column made of `ids` right where they are read, and returned under its own name in their place.

    Starts come from the counts beside the frames: summed within a file, then over files, of which there are as
    many as tasks that wrote. A frame's few hundred thousand ids are what a task holds at once.
    """
    frames = spark.read.parquet(path)
    # The key's own type comes back from the list's.
    kind = frames.schema["keys"].dataType.elementType
    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("part", T.IntegerType()), T.StructField("frame", T.IntegerType())]
        + [T.StructField("within", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    rows = frames.select("keys", "part", "frame", "image").mapInArrow(_read, schema)
    rows = rows.select("key", "part", "frame", "within", "n_ids", F.col("ids") if value is None else value)
    counts = frames.select(F.col("part").alias("_part"), F.col("frame").alias("_frame"), F.col("n_ids").alias("_n"))
    before = Window.unboundedPreceding, -1
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_n"))
    parts = parts.select(F.col("_part").alias("_file"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*before)), F.lit(0)).alias("_file_base"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_frame").rowsBetween(*before)), F.lit(0))
    base = counts.withColumn("_in", inside).join(parts, F.col("_part") == F.col("_file"))
    base = base.select("_part", "_frame", (F.col("_file_base") + F.col("_in")).alias("_base"))
    return rows.join(base, (F.col("part") == F.col("_part")) & (F.col("frame") == F.col("_frame"))).select(
        "key", (F.col("_base") + F.col("within")).alias("start"), "n_ids", rows.columns[-1]
    )
