"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens at once.

Each task packs what it reads, in one pass, with a bounded pool of waiting examples. The open bin takes the example
whose vector of demands has the greatest dot product with the bin's weighted room, among those that fit; an example
that does not fit whole may be cut to fill the bin up. Nothing is shuffled, and no task sees more than its own
partition, so padding is that of a few last bins per partition at any size of input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.tokens import batched, file_encoder

WIDTH = 4  # bytes of an id


@dataclass(frozen=True)
class Limits:
    """Of one bin. `pool`: examples that wait for a place in each task."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    pool: int = 256

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.pool) < 1:
            raise ValueError("limits must be positive")


class Item:
    """An example, or what is left of one: `at` ids have been placed. `mask`: 1 where an id bears loss; none: all do."""

    __slots__ = ("key", "ids", "at", "size", "sums")

    def __init__(self, key, ids: bytes, mask: np.ndarray | None = None):
        self.key, self.ids, self.at, self.size = key, ids, 0, len(ids) // WIDTH
        self.sums = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    @property
    def left(self) -> int:
        return self.size - self.at

    @property
    def loss(self) -> int:
        return self.left if self.sums is None else int(self.sums[-1] - self.sums[self.at])

    def most(self, tokens: int, loss: int) -> int:
        """The longest next piece within both limits."""
        n = min(self.left, tokens)
        if self.sums is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.sums, self.sums[self.at] + loss, "right")) - 1 - self.at)


@dataclass
class Piece:
    key: object
    ids: bytes
    start: int
    length: int
    loss: int
    total: int
    sequence: int
    offset: int
    segment: int


class Packer:
    """Fed with examples, gives pieces. `cut`: examples may be cut anywhere; else only those too large for an empty bin."""

    def __init__(self, limits: Limits, cut: bool = True):
        self.limits, self.cut = limits, cut
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Item] = []
        self.need = np.zeros((limits.pool + 1, 3))
        self.weights = np.ones(3)
        self.seen, self.total = 0, np.zeros(3)
        self.sequence = 0
        self.cap = limits.tokens
        self._open()

    def _open(self):
        self.room = [self.cap, self.limits.segments, self.limits.loss]
        self.used = 0

    def _close(self):
        self.sequence += 1
        self._open()

    def _place(self, item: Item, n: int) -> Piece:
        before = item.loss
        piece = Piece(item.key, item.ids[item.at * WIDTH : (item.at + n) * WIDTH], item.at, n, 0, item.size, self.sequence, self.used, self.limits.segments - self.room[1])
        item.at += n
        piece.loss = before - item.loss
        self.used += n
        self.room = [self.room[0] - n, self.room[1] - 1, self.room[2] - piece.loss]
        return piece

    def add(self, item: Item) -> Iterator[Piece]:
        if item.size == 0:
            return
        v = np.array([item.left, 1, item.loss]) / self.full
        self.seen, self.total = self.seen + 1, self.total + v
        self.weights = self.total / self.seen  # demand in a dimension is its weight
        self.need[len(self.pool)] = (item.left, 1, item.loss)
        self.pool.append(item)
        while len(self.pool) >= self.limits.pool:
            yield from self._step()

    def flush(self) -> Iterator[Piece]:
        """Place what waits. The last ids, fewer than a bin, go to bins of 1, 2, 4, ... ids if cutting is free:
        a power of two needs no padding."""
        while self.pool:
            if self.cut and not self.used:
                rest = sum(i.left for i in self.pool)
                self.cap = self.limits.tokens if rest >= self.limits.tokens else 1 << (rest.bit_length() - 1)
                self._open()
            yield from self._step()
        if self.used:
            self._close()
        self.cap = self.limits.tokens
        self._open()

    def _step(self) -> Iterator[Piece]:
        """Place one piece, or close the bin if nothing goes in."""
        need = self.need[: len(self.pool)]
        room = np.array(self.room, float)
        score = (need / self.full) @ (self.weights * room / self.full)
        fits = (need <= room).all(axis=1)
        if fits.any():
            k = int(np.argmax(np.where(fits, score, -1)))
            take = self.pool[k].left
        else:
            empty = not self.used
            k = int(np.argmax(score))
            take = self.pool[k].most(self.room[0], self.room[2]) if self.room[1] and (self.cut or empty) else 0
            if take <= 0:
                self._close()
                return
        item = self.pool[k]
        yield self._place(item, take)
        if item.left:
            self.need[k] = (item.left, 1, item.loss)
        else:
            self.pool[k], self.need[k] = self.pool[-1], self.need[len(self.pool) - 1]
            self.pool.pop()
        if self.room[0] == 0 or self.room[1] == 0:
            self._close()


def pieces_schema(key: T.DataType) -> T.StructType:
    longs = ["start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "segment"]
    return T.StructType([T.StructField("key", key), T.StructField("ids", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in longs])


def _table(pieces: list[Piece], key: pa.DataType, base: int) -> pa.RecordBatch:
    col = lambda f: pa.array([f(p) for p in pieces], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p.key for p in pieces], key),
            pa.array([p.ids for p in pieces], pa.binary()),
            col(lambda p: p.start),
            col(lambda p: p.length),
            col(lambda p: p.loss),
            col(lambda p: p.total),
            col(lambda p: base + p.sequence),
            col(lambda p: p.offset),
            col(lambda p: p.segment),
        ],
        ["key", "ids", "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "segment"],
    )


def _packed(batches, items: Callable[[pa.RecordBatch], Iterator[Item]], limits: Limits, cut: bool, rows: int = 512):
    # Numbers of sequences begin with that of the partition, so tasks need not know of each other.
    base = TaskContext.get().partitionId() << 40
    packer, held, key = Packer(limits, cut), [], None
    for b in batched(batches):
        key = b.schema.field(0).type
        for item in items(b):
            held.extend(packer.add(item))
            if len(held) >= rows:
                yield _table(held, key, base)
                held = []
    held.extend(packer.flush())
    if held:
        yield _table(held, key, base)


def pack(examples: DataFrame, key: str, ids: str, mask: str | None = None, limits: Limits = Limits(), cut: bool = False) -> DataFrame:  # noqa: B008
    """Pack examples of an array of ids, and an array of 0 and 1 for loss, into bins.

    Returns a row for each piece: key, ids (little-endian 32-bit), start, length, loss_tokens, doc_tokens,
    sequence_id, offset, segment. Examples without ids, null or empty, give no row; a null mask means that all
    bear loss; a mask of another length is an error. Repeated rows and equal or null keys are examples of their
    own. Only the named columns are read.
    """

    def items(b: pa.RecordBatch) -> Iterator[Item]:
        masks = b.column(2).to_pylist() if mask else [None] * b.num_rows
        for k, v, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), masks):
            if m is not None and len(m) != len(v or []):
                raise ValueError(f"mask of {len(m)} for {len(v or [])} ids")
            yield Item(k, np.array(v or [], "<u4").tobytes(), None if m is None else np.array(m, np.int64))

    cols = [key, ids] + ([mask] if mask else [])
    return examples.select(*cols).mapInArrow(lambda it: _packed(it, items, limits, cut), pieces_schema(examples.schema[key].dataType))


def pack_texts(docs: DataFrame, key: str, text: str, vocabulary: str, end: Sequence[int], limits: Limits = Limits(), cut: bool = True, bare: bool = True) -> DataFrame:  # noqa: B008
    """Encode texts with a tokenizers file, append the ids of `end`, and pack; all ids bear loss. See `pack`.

    A null text is an empty one and still has its end.
    """
    tail = np.array(end, "<u4").tobytes()

    def items(b: pa.RecordBatch) -> Iterator[Item]:
        ids, at = file_encoder(vocabulary, bare)(b.column(1))
        for k, first, last in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
            yield Item(k, ids[first:last].tobytes() + tail)

    return docs.select(key, text).mapInArrow(lambda it: _packed(it, items, limits, cut), pieces_schema(docs.schema[key].dataType))
