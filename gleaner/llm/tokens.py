"""Encoding many texts with a vocabulary file, word by word through a bounded cache.

No token spans the gap before a word, so words are encoded apart. The words of a batch are cut where its bytes say so,
numbered by a dictionary, and each different one is looked up once; the ids of all are then gathered in one step. Ids
are little-endian unsigned 32-bit integers throughout.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

# A text is looked at in pieces of about so many bytes.
STRETCH = 1 << 21
# What an entry of a cache takes beside its bytes.
ENTRY = 180

_loaded: dict[str, tuple[tuple, object]] = {}


def once(key: tuple, make: Callable[[], object]):
    """One object of a kind, `key[0]`, per Python worker: another of the same kind takes its place."""
    held = _loaded.get(key[0])
    if held is None or held[0] != key:
        _loaded.pop(key[0], None)
        held = _loaded[key[0]] = (key, make())
    return held[1]


class Cache:
    """Ids of words, by `encode` on lists of new ones, which gives words with their ids. Two generations bound the memory, each by `limit` bytes and
    one batch: what is not used while so much else comes goes away."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable[tuple[bytes, bytes]]], limit: int = 48 << 20):
        self.encode, self.limit, self.size = encode, limit, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each of some words."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        young, old = self.young, self.old
        missing = set(words).difference(young)
        if missing:
            known = {w: v for w in missing if (v := old.get(w)) is not None}
            rest = list(missing.difference(known))
            known.update(self.encode(rest))
            young.update(known)
            self.size += sum(map(len, known)) + sum(map(len, known.values())) + ENTRY * len(known)
        return list(map(young.__getitem__, words))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column one after the other, and where each begins, with the end of all; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def gathered(data: np.ndarray, cuts: np.ndarray, ids: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words that follow one another between `cuts`, and how many each word has."""
    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    each = ids(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy()
    flat = np.frombuffer(b"".join(each), "<u4")
    size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
    n = size[at]
    shift = np.repeat((np.cumsum(size) - size)[at] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(len(shift))], n


def _table(of: str | Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in of]] = True
    return out


GAPS = _table(" \n\t\r")
# White space of one byte; the last three are separators of files, groups and records.
BLANKS = _table(" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
PLAIN = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
STOPS = _table(".,")
# Second bytes of Latin letters that begin with C3: all but the signs of multiplication and division.
LATIN = _table(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))


def word_begins(data: np.ndarray, stops: bool = True) -> np.ndarray:
    """True where a word begins: at a gap after what is no white space, and at a stop or comma after a letter or digit.

    No token of the vocabularies in use holds both sides of such a place. Wider white space than one byte is told by
    its lead bytes, which some other characters share; a place that is not cut makes a longer word, not another id.
    """
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    back = lambda k: np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if len(data) > k else np.zeros(len(data), np.uint8)
    b1, b2, b3 = back(1), back(2), back(3)
    wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A)))
    out |= GAPS[data] & ~BLANKS[b1] & ~(wide & (b1 >= 0x80))
    if stops:
        out |= STOPS[data] & (PLAIN[b1] | ((b2 == 0xC3) & LATIN[b1]))
    return out


def pieces(data: np.ndarray, begins: np.ndarray, size: int = STRETCH) -> Iterator[tuple[int, np.ndarray]]:
    """Where a piece of about `size` bytes begins, and the cuts of its words; `begins` is true at the first byte."""
    at = np.append(np.nonzero(begins)[0], len(data))
    k = 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield int(at[k]), at[k : end + 1] - at[k]
        k = end


def encoded(column: pa.Array, begins: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column's texts, and where each text's begin, with the end of all."""
    data, at = bytes_of(column)
    if not len(data):
        return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
    marks = begins(data, at)
    marks[at[:-1][at[:-1] < len(data)]] = True
    out, cuts, counts = [], [], []
    for first, of in pieces(data, marks):
        some, n = gathered(data[first : first + of[-1]], of, ids)
        out.append(some)
        cuts.append(of[:-1] + first)
        counts.append(n)
    cut, ends = np.concatenate(cuts), np.append(0, np.cumsum(np.concatenate(counts)))
    return np.concatenate(out).astype("<u4", copy=False), ends[np.searchsorted(cut, at)]


# A word of ASCII and Latin letters, perhaps after one space.
SIMPLE = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _small(word: bytes) -> bytes:
    """In lower case if it is a simple word, else A to Z alone are: the tokenizer sees to the rest."""
    if word.isascii() or not SIMPLE(word):
        return word.lower()
    return word.decode().lower().encode()


def _letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in seen else chr(next(rest)) for b in range(256))


def file_encoder(path: str, bare: bool) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encode whole texts with a tokenizers file: all ids, and where each text's begin. No special tokens; their
    strings are ordinary text.

    `bare` for vocabularies that drop white space and case: words are then kept without either (A to Z only).
    """

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True

        apart, letters = tok.model.tokenize, _letters()

        def others(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
            for i in range(0, len(words), 512):
                some = words[i : i + 512]
                e = tok.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
                ids, of = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids, np.int64)
                cuts = (np.searchsorted(of, np.arange(len(some) + 1)) * 4).tolist()
                yield from ((w, ids[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))

        def encode(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
            odd = []
            for w in words:
                if SIMPLE(w):
                    # One token before merging, so the model alone has to see it.
                    yield w, array("I", [t.id for t in apart(w.decode("latin-1").translate(letters))]).tobytes()
                else:
                    odd.append(w)
            yield from others(odd)

        cache = Cache(encode)
        ids = (lambda words: cache.ids([_small(w.strip(b" \n\t\r")) for w in words])) if bare else cache.ids
        # A capital sigma's small form hangs on letters beyond a stop.
        sigma = "Σ".encode()
        begins = lambda data, _: word_begins(data, not bare or sigma not in data.tobytes())
        return lambda column: encoded(column, begins, ids)

    return once(("file", path, bare), make)


def batched(batches: Iterable[pa.RecordBatch], text_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about so many bytes, so that long texts do not add up in a worker."""
    for b in batches:
        rows = max(1, int(b.num_rows * text_bytes / max(1, b.nbytes))) if b.num_rows else 1
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Texts as Python strings; null is empty."""
    return [t or "" for t in column.to_pylist()]
