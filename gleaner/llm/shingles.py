"""Word shingles of many texts at once, as 64-bit hashes made from the bytes of a batch.

Words are runs of anything but the six ASCII spaces, A to Z in lower case. A text's set holds the hashes of its
distinct five-word shingles; of its whole sequence if it has fewer words; nothing without words. Two different
shingles of two texts share a hash once in 2 ** 64 times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WIDTH = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_SEQ = 0xD1B54A32D192ED03 | 1
_STEPS = [pow(0xBF58476D1CE4E5B9, j, 1 << 64) for j in range(WIDTH)]

_powers: dict[int, np.ndarray] = {}
_letters = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, base, np.uint64)]))
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@dataclass
class Sets:
    """Of the texts of a batch: `keys` of their word sequences, numbers of words, and sorted distinct hashes."""

    keys: np.ndarray
    words: np.ndarray
    sets: list[np.ndarray]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def shingled(column: pa.Array) -> Sets:
    rows = len(column)
    if not rows:
        return Sets(np.zeros(0, np.uint64), np.zeros(0, np.int64), [])
    with np.errstate(over="ignore"):
        raw, at = _bytes_of(column)
        n = len(raw)
        low = raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.zeros(n + 1, bool)  # a row begins or ends
        edge[at] = True
        begin = np.nonzero(word & (edge[:n] | ~np.append(False, word[:-1])))[0]
        end = np.nonzero(word & (edge[1:] | ~np.append(word[1:], False)))[0] + 1
        sums = np.concatenate([[_U(0)], np.cumsum(_letters[low] * _power(_BASE, n), dtype=np.uint64)])
        back = _power(_BACK, n + 1)
        w = mixed((sums[end] - sums[begin]) * back[begin])
        first = np.searchsorted(begin, at)  # the first word of each row
        counts = np.diff(first)
        m = len(w)
        # Hash of the sequence: its words by their places.
        place = np.arange(m) - np.repeat(first[:-1], counts)
        total = np.concatenate([[_U(0)], np.cumsum(w * _power(_SEQ, int(counts.max(initial=0)) + 1)[place], dtype=np.uint64)])
        keys = mixed(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64) * _U(_BASE))
        five = np.zeros(m, np.uint64)
        for j in range(WIDTH):
            if m > j:
                five[: m - j] += w[j:] * _U(_STEPS[j])
        five = mixed(five)
        sets = []
        for s, c, key in zip(first[:-1].tolist(), counts.tolist(), keys):
            if c >= WIDTH:
                sets.append(np.unique(five[s : s + c - WIDTH + 1]))
            else:
                sets.append(np.array([key ^ _U(_SEQ)] if c else [], np.uint64))
        return Sets(keys, counts.astype(np.int64), sets)
