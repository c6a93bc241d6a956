"""Byte-level BPE by a rank file: boundaries by a scan over classes of code points, merges by cached words.

A text is an array of code points. A table gives each its class (letter, number, white space, other). What cannot be
told from neighbours alone is where an apostrophe begins a contraction, as that depends on the token before it: each
code point is a function on the four states below, functions are composed by a table, and composition being
associative the states of all places come from a scan in blocks. No regular expression is run.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.llm.tokens import Cache, batched, encoded, once

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# White space in the pattern's sense, and the contractions, which are tokens of their own.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
APOSTROPHE = ord("'")

# States before a place. FREE: an apostrophe here would begin a token. JOINED: it would go on with one, of marks or
# a space. TWO, ONE: so many letters of a contraction are to come.
FREE, JOINED, TWO, ONE = 0, 1, 2, 3
LANES = 256
SHORT_WORD = 48  # bytes


def _function(free: int, joined: int, two: int, one: int) -> int:
    """Four states, two bits each: where each state goes."""
    return free | joined << 2 | two << 4 | one << 6


#: What a code point does to the state.
BREAKS = _function(FREE, FREE, ONE, FREE)  # letters, numbers, white space that joins nothing
JOINS = _function(JOINED, JOINED, JOINED, JOINED)  # marks, and a space before a token
SHORT = _function(ONE, JOINED, JOINED, JOINED)  # an apostrophe before one letter of a contraction
LONG = _function(TWO, JOINED, JOINED, JOINED)
IDENTITY = _function(FREE, JOINED, TWO, ONE)


def _compositions() -> np.ndarray:
    """table[f, g]: first f, then g."""
    f = np.arange(256)
    image = lambda f, s: f >> (2 * s) & 3
    out = np.zeros((256, 256), np.int64)
    for s in range(4):
        out |= image(f[None, :], image(f[:, None], s)) << (2 * s)
    return out.astype(np.uint8)


THEN = _compositions()


def classes() -> np.ndarray:
    """The class of every code point, from the Unicode categories."""

    def make():
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        for a, b in WHITE:
            out[a : b + 1] = SPACE
        return out

    return once(("classes",), make)


def scan(functions: np.ndarray) -> np.ndarray:
    """Composition of all functions up to and with each place.

    Lanes of equal length go side by side, then the lanes' totals are composed by doubling, then put before each lane.
    """
    n = len(functions)
    if not n:
        return functions
    length = -(-n // LANES)
    grid = np.full(LANES * length, IDENTITY, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(LANES, length).T)  # a row for each step
    for i in range(1, length):
        grid[i] = THEN[grid[i - 1], grid[i]]
    total, step = grid[-1].copy(), 1
    while step < LANES:
        total[step:] = THEN[total[:-step], total[step:]]
        step *= 2
    before = np.concatenate([[np.uint8(IDENTITY)], total[:-1]])
    return THEN[before[None, :], grid].T.reshape(-1)[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a token begins. `points`: code points of texts one after the other, each begun at one of `firsts`."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[firsts] = True
    begin[n] = True
    last = begin[1:]  # of a text
    begin = begin[:n]
    white, plain = kind == SPACE, points == 0x20
    next_white = np.append(white[1:], True) | last
    joins = plain & ~next_white  # a single space, or the last of a run, before a token
    # An apostrophe followed by the letters of a contraction in the same text.
    of = np.nonzero(points == APOSTROPHE)[0]
    size = np.zeros(len(of), np.int64)
    padded = np.append(points, [0, 0])
    end1 = last[of]
    end2 = end1 | last[np.minimum(of + 1, n - 1)]
    for e in ENDINGS:
        hit = ~(end1 if len(e) == 1 else end2)
        for j, c in enumerate(e):
            hit = hit & (padded[of + 1 + j] == ord(c))
        size[hit & (size == 0)] = len(e)
    function = np.full(n, BREAKS, np.uint8)
    function[(kind == OTHER) | joins] = JOINS
    function[of[size == 1]] = SHORT
    function[of[size == 2]] = LONG
    # A text begins free, whatever was before it.
    f0 = function[firsts] & 3
    function[firsts] = f0 | f0 << 2 | f0 << 4 | f0 << 6
    state = scan(function) & 3  # after each place, as all begins free
    before = np.append(FREE, state[:-1]).astype(np.uint8)
    before[firsts] = FREE
    inside = (before == TWO) | (before == ONE)
    ended = np.zeros(n, bool)  # a contraction ended just before
    ended[1:] = inside[:-1] & (state[:-1] == FREE)
    # Between neighbours of one class there is no boundary, but for runs of white space: the last of one that
    # a token follows stands alone or joins it.
    prev = np.append(kind[:1], kind[:-1])
    joined = np.append(False, joins[:-1])
    out = (kind != prev) & ~joined
    out |= white & np.append(False, white[:-1]) & ~next_white
    out |= ended
    out &= ~inside
    return out | begin


def token_begins(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """`boundaries` over UTF-8 bytes: true at the first byte of each token. `firsts`: where texts begin, with the end of all."""
    starts = np.nonzero((data & 0xC0) != 0x80)[0]  # of code points
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    out = np.zeros(len(data), bool)
    texts = firsts[:-1][firsts[:-1] < firsts[1:]]
    out[starts[boundaries(points, np.searchsorted(starts, texts))]] = True
    return out


class Ranks:
    """A vocabulary of byte strings with ranks, as in a .tiktoken file."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        top = max(self.rank.values()) + 1
        parts = [b""] * top
        for token, r in self.rank.items():
            parts[r] = token
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.cache = Cache(lambda ws: zip(ws, map(self.merged, ws)))

    def merged(self, word: bytes) -> bytes:
        """Ids of one word: the pair of lowest rank is merged, the leftmost first, until none is in the vocabulary."""
        rank = self.rank
        if (r := rank.get(word)) is not None:
            return r.to_bytes(4, "little")
        n = len(word)
        if n <= SHORT_WORD:
            return self._merged_short(word)
        # Parts are linked by their places; a heap holds the pairs that may merge.
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n:
                continue
            j = end[i]
            if end[j] != e:
                continue
            alive[j] = 0
            end[i] = e
            if e < n:
                prev[e] = i
                if (r := rank.get(word[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := rank.get(word[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = end[i]
        return array("I", out).tobytes()

    def _merged_short(self, word: bytes) -> bytes:
        """The same over plain lists, for words of few bytes."""
        rank, none = self.rank, len(self.size)
        of = rank.get
        cuts = list(range(len(word) + 1))
        pair = [of(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pair and (least := min(pair)) < none:
            i = pair.index(least)
            del cuts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = of(word[cuts[i] : cuts[i + 2]], none)
            if i:
                pair[i - 1] = of(word[cuts[i - 1] : cuts[i + 1]], none)
        return array("I", [rank[word[a:b]] for a, b in zip(cuts, cuts[1:])]).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts, and where each text's begin, with the end of all."""
        return encoded(column, token_begins, self.cache.ids)

    def each(self, column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
        """The ids of each text, with its place in the column."""
        ids, at = self.encode(column)
        return ((ids[a:b], i) for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The first byte of each token in the decoded text."""
        size = self.size[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of all tokens, gathered at once; `offsets` are those kept from encoding."""
        size = self.size[ids]
        shift = np.repeat(self.begin[ids] - (self.offsets(ids) if offsets is None else offsets), size)
        return self.flat[shift + np.arange(len(shift))].tobytes()


def ranks(path: str) -> Ranks:
    def make():
        fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with fs.open_input_stream(name) as f:
            return Ranks(f.read())

    return once(("ranks", path), make)


def _added(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    taken = {f.name for f in fields}
    if clash := taken & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return T.StructType([*df.schema.fields, *fields])


def encode(docs: DataFrame, text: str, vocabulary: str, ids: str = "ids", offsets: str | None = "offsets") -> DataFrame:
    """Add the ids of a text, and each token's first byte; both little-endian 32-bit, in binary.

    A null or empty text has no ids. All other columns are kept; the new names must be free. Each row is encoded
    alone, so repeated rows and ties need no rule.
    """
    names = [ids] + ([offsets] if offsets else [])
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(vocabulary)
        for b in batched(batches):
            got = [g for g, _ in r.each(b.column(at))]
            cols = [pa.array([g.tobytes() for g in got], pa.binary())]
            if offsets:
                cols.append(pa.array([r.offsets(g).astype("<u4").tobytes() for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return docs.mapInArrow(run, _added(docs, [T.StructField(n, T.BinaryType()) for n in names]))


def decode(rows: DataFrame, ids: str, vocabulary: str, out: str = "decoded", offsets: str | None = None) -> DataFrame:
    """Add the bytes that ids stand for; null ids give none. An id outside the vocabulary is an error."""
    at = rows.columns.index(ids)
    where = rows.columns.index(offsets) if offsets else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(vocabulary)
        for b in batched(batches):
            kept = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in b.column(where).to_pylist()] if offsets else [None] * b.num_rows
            got = [r.decode(np.frombuffer(x or b"", "<u4"), o) for x, o in zip(b.column(at).to_pylist(), kept)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, out])

    return rows.mapInArrow(run, _added(rows, [T.StructField(out, T.BinaryType())]))


def transcoded(docs: DataFrame, text: str, vocabulary: str, columns: Mapping[str, tuple[T.DataType, Callable[[np.ndarray, bytes], object]]]) -> DataFrame:
    """Encode each text, decode its ids again with their offsets, and add what `columns` make of ids and decoded bytes.

    One Python worker a task does all three, and neither ids nor bytes leave it, so this is the way to check or
    measure an encoding over a large table. As in `encode`, a null or empty text has no ids, rows are alone, columns
    are kept and new names must be free.
    """
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(vocabulary)
        kinds = [to_arrow_type(kind) for kind, _ in columns.values()]
        for b in batched(batches):
            rows = []
            for ids, _ in r.each(b.column(at)):
                back = r.decode(ids, r.offsets(ids))
                rows.append([make(ids, back) for _, make in columns.values()])
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *columns])

    return docs.mapInArrow(run, _added(docs, [T.StructField(n, kind) for n, (kind, _) in columns.items()]))
