"""Toxicity by compression distance: two zstandard dictionaries, and the windows of a text under each.

One dictionary is trained on ordinary text. The other has the same bytes but for a stretch at its far end, trained on
what is telling of toxic text: words far more frequent there than in ordinary text, in several surroundings. So a
window is as long under both unless toxic matter shortens it, and the difference is its gain. (Two dictionaries trained
apart, each on its whole texts, differ more by which ordinary words they happen to hold than by toxic ones.) A text's
gains (greatest, second, mean, share of high ones) give a score by a logistic model, fitted on labelled texts that
neither dictionary has seen and weighted to the share of toxic labels, so that scores are probabilities.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tokens import batched, once, texts_of

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 16  # words
LEVEL = 12
ORDINARY_BYTES, TOXIC_BYTES = 32768, 2048
SEGMENT = 32  # bytes that training takes at once: some words
TABLES = 512  # a trained dictionary begins with tables that are of no use as content
HIGH = 3  # bytes of gain
CHUNK = 256  # bytes of an ordinary sample
RATIO = 32  # by how much a word must be more frequent among toxic texts


@dataclass(frozen=True)
class Bounds:
    """Of the labelled sample that a model is fitted on: texts of each class for the dictionaries and for the scores,
    the longest text that it takes, and how much ordinary text zstandard trains on, both in bytes. Nothing else is
    bounded, so the driver gets 180 MB of text at most."""

    toxic: int = 2000
    ordinary: int = 6000
    toxic_scored: int = 1000
    ordinary_scored: int = 2000
    text_bytes: int = 16384
    train_bytes: int = 8 << 20


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = field(default=())

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Between 0 and 1; 0 for all if there was nothing to learn from."""
        if not self.weights:
            return np.zeros(len(texts))
        return _sigmoid(features(self, texts) @ np.array(self.weights))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(text: str) -> list[bytes]:
    w = words(text)
    return [f" {' '.join(w[i : i + WINDOW])} ".encode("utf-8", "surrogatepass") for i in range(0, len(w), WINDOW)]


def _compressors(model: Model) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    """Of ordinary and of toxic text."""

    def make(content: bytes) -> zstd.ZstdCompressor:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        bare = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
        return zstd.ZstdCompressor(dict_data=d, compression_params=bare)

    return once(("zstd", model.ordinary, model.toxic), lambda: (make(model.ordinary), make(model.toxic)))


def gains(model: Model, text: str) -> np.ndarray:
    """By how many bytes the toxic dictionary shortens each window beyond the ordinary one."""
    plain, toxic = (c.compress for c in _compressors(model))
    return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)


def features(model: Model, texts: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(texts), 8))
    for i, t in enumerate(texts):
        g = gains(model, t)
        out[i, 0] = 1
        if len(g):
            top = np.sort(g)[::-1][:2]
            first, second = top[0], top[1] if len(top) > 1 else 0.0
            out[i, 1:] = first, second, g.mean(), (g >= HIGH).mean(), math.log(len(g)), first * math.log(len(g)), min(first, 6) ** 2
    return out


def telling(toxic: Sequence[str], ordinary: Sequence[str]) -> list[bytes]:
    """What training gets of each toxic text: its words that are far more frequent among toxic texts than among ordinary ones.

    Rates are of texts, so an ordinary text that quotes a word, or a wrong label, takes little away. A word must also
    follow several different words: copies of one text repeat its words in one surrounding only.
    """
    after, rate, common = defaultdict(set), defaultdict(int), defaultdict(int)
    for t in toxic:
        last, ws = "", words(t)
        for w in ws:
            after[w].add(last)
            last = w
        for w in set(ws):
            rate[w] += 1
    for t in ordinary:
        for w in set(words(t)):
            common[w] += 1
    least = max(4, math.ceil(0.0025 * len(toxic)))
    far = lambda w: rate[w] * max(1, len(ordinary)) > RATIO * common[w] * len(toxic)
    kept = {w for w, before in after.items() if len(before) >= least and far(w)}
    out = [" ".join(dict.fromkeys(w for w in words(t) if w in kept)) for t in toxic]
    return [f" {s} ".encode() for s in out if s]


def _trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary's bytes; samples that fit into one whole are that dictionary, as there is nothing to choose."""
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    return zstd.train_dictionary(size + TABLES, samples, **how).as_bytes()[-size:]


def train(toxic: Sequence[str], ordinary: Sequence[str], train_bytes: int = Bounds.train_bytes) -> Model | None:
    """The two dictionaries; none if no word is telling."""
    new = telling(toxic, ordinary)
    if not new:
        return None
    joined = [" ".join(words(t)).encode() for t in ordinary]
    plain = [t[i : i + CHUNK] for t in joined for i in range(0, len(t), CHUNK)]
    np.random.default_rng(1).shuffle(plain)
    base = _trained(ORDINARY_BYTES + TOXIC_BYTES, plain[: max(1, train_bytes // CHUNK)])
    lists = [f" {' '.join(w)} ".encode() for s in new for w in _grouped(s.decode().split(), 8)]
    own = _trained(TOXIC_BYTES, lists, k=SEGMENT, d=6, f=20, accel=1, steps=1)
    # The stretch that is exchanged is the farthest and least useful one.
    return Model(base, own + base[len(own) :])


def _grouped(items: list, size: int) -> Iterator[list]:
    return (items[i : i + size] for i in range(0, len(items), size))


def calibrated(model: Model, texts: Sequence[str], labels: Sequence[int], share: float) -> Model:
    """Weights by Newton steps on the logistic loss, each class weighted to its share, with a small ridge."""
    x, y = features(model, texts), np.array(labels, float)
    if y.min(initial=1) == y.max(initial=0):
        return model
    scale = np.append(1.0, x[:, 1:].std(axis=0))
    scale[scale == 0] = 1
    x = x / scale
    each = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (each * p * (1 - p))) @ x + ridge, x.T @ (each * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.ordinary, model.toxic, tuple((w / scale).tolist()))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column, bounds: Bounds = Bounds()) -> Model:  # noqa: B008
    """Fit on the labelled rows where `learn` (over `labels`) is true.

    The sample is bounded by `bounds`: rows of each class with the least hashes of their keys. Null keys and texts, and
    labels other than 0 and 1 are left out, a key labelled twice counts as toxic if it is once. The share of toxic labels is counted over
    all of them. Without labels of both classes, or without a telling word, every score is 0.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isin(0, 1))
    rows = known.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    total = sum(counts.values())
    if not counts.get(1) or counts.get(1) == total:
        return Model(b"", b"")
    picked = None
    for of, n in ((1, bounds.toxic + bounds.toxic_scored), (0, bounds.ordinary + bounds.ordinary_scored)):
        part = rows.where(F.col("_label") == of).orderBy(F.xxhash64("_key"), "_key").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    short = docs.where(F.octet_length(text) <= bounds.text_bytes).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # At most the sum of the bounds in keys.
    got = short.join(F.broadcast(picked), F.col("_id") == F.col("_key")).select("_key", "_label", "_text").orderBy(F.xxhash64("_key"), "_text").collect()
    by = {k: [r["_text"] for r in got if r["_label"] == k] for k in (0, 1)}
    cut = {k: max(1, len(v) * a // (a + b)) for (k, v), (a, b) in zip(by.items(), ((bounds.ordinary, bounds.ordinary_scored), (bounds.toxic, bounds.toxic_scored)))}
    model = train(by[1][: cut[1]], by[0][: cut[0]], bounds.train_bytes)
    if model is None:
        return Model(b"", b"")
    rest = [(t, k) for k in (0, 1) for t in by[k][cut[k] :]]
    return calibrated(model, [t for t, _ in rest], [k for _, k in rest], counts[1] / total)


def scored(docs: DataFrame, text: str, model: Model, out: str = "score") -> DataFrame:
    """Add the score of each whole text; a null or empty one gets that of a text without windows.

    Rows are scored alone and all other columns kept; the new name must be free.
    """
    if out in docs.columns:
        raise ValueError(f"column exists already: {out}")
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            got = pa.array(model.scores(texts_of(b.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
