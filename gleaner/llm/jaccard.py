"""Jaccard join of texts on word shingles: rare-first prefix filtering.

1. One pass over the texts gives each its class (equal word sequences), the size of its set, and a count of all
   shingles in a table of fixed size. The table orders shingles, rare first: any order gives the same links, a good
   one gives few candidates.
2. A second pass gives for each class the shingles of its prefix: two sets can only reach the threshold if their
   prefixes share one. Rows meet by shingle, sorted by size; length and positional filters are applied there.
3. A shingle of many texts makes no pairs of all with all. Each member is first paired with a leader, one of those
   that have the least to themselves. Pairs are verified once against the texts, after a suffix filter, and components
   are formed; then only pairs that still lie in different components are made and verified. So a group of n near
   copies costs about n verifications, and no link that would join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shingles import shingled
from gleaner.llm.tokens import batched
from gleaner.session import stored

THRESHOLD = 75  # per cent
# Counts of shingles: 2 ** BITS of them, whatever the input; they travel in chunks.
BITS, CHUNK = 20, 4096
SEEN = 500_000  # classes a task remembers, so as not to send copies again
# Bytes of text whose words are hashed at once: some twenty arrays of eight times that are alive then.
STRETCH = 1 << 19


def needed(n, percent: int):
    """The least number of shared shingles of a set of n with any set that reaches the threshold."""
    return (percent * n + 99) // 100


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


SURVEY = "id long, class long, n_shingles long, chunk int, counts binary"


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; at the end of the task its counts of shingles, in chunks."""
    counts, held, size = np.zeros(1 << BITS, np.int64), [], 0
    names = ["id", "class", "n_shingles", "chunk", "counts"]

    def count():
        if held:
            np.add(counts, np.bincount(bucket(np.concatenate(held)), minlength=1 << BITS), out=counts)
            held.clear()

    for b in batched(batches, STRETCH):
        s = shingled(b.column(1))
        held.extend(s.sets)
        size += sum(map(len, s.sets))
        if size > 1 << BITS:
            count()
            size = 0
        n = b.num_rows
        sizes = pa.array([len(x) for x in s.sets], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(s.keys)), sizes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    count()
    parts = counts.reshape(-1, CHUNK)
    some = np.nonzero(parts.any(axis=1))[0]
    if len(some):
        data = pa.array([parts[i].astype("<u4").tobytes() for i in some], pa.binary())
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(some.astype(np.int32)), data], names)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, "<u4").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


def survey(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """Rows id, class, n_shingles for every document, and the table of counts (8 MB at any size of input)."""
    both = stored(docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(_survey, SURVEY), "survey")
    parts = both.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition("chunk").mapInArrow(_summed, "chunk int, counts binary")
    counts = np.zeros(1 << BITS, np.int64)
    for r in parts.collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return both.where(F.col("chunk").isNull()).select("id", "class", "n_shingles"), counts


PREFIXES = "shingle long, class long, size int, place int"


def prefixes(docs: DataFrame, text: str, counts: np.ndarray, percent: int = THRESHOLD) -> DataFrame:
    """The prefix of each text's set in the order of counts, rare first: shingle, class, size, place.

    Copies that a task has sent are not sent again; other tasks may send them too.
    """
    table = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = table.value, set()
        for b in batched(batches, STRETCH):
            s = shingled(b.column(0))
            out = []
            for key, h in zip(s.keys.tolist(), s.sets):
                n = len(h)
                if not n or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                p = n - needed(n, percent) + 1
                first = np.lexsort((h, order[bucket(h)]))[:p]
                out.append((h[first], np.full(p, key, np.uint64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(cols[0])), pa.array(_signed(cols[1])), pa.array(cols[2]), pa.array(cols[3])], ["shingle", "class", "size", "place"])

    return docs.select(text).mapInArrow(run, PREFIXES)


def may_link(size_a, place_a, size_b, place_b, percent: int, least):
    """Length and positional filter for two members of a shingle, of columns or numbers; `least` is their minimum.

    The shingle is taken for the first that the two share: then they share it and the lesser rest after it at most.
    Sets that reach the threshold pass at the shingle that is their first, so each such pair is found there.
    """
    small = least(size_a, size_b)
    most = 1 + least(size_a - place_a - 1, size_b - place_b - 1)
    both = size_a + size_b
    return (100 * small >= percent * (both - small)) & ((100 + percent) * most >= percent * both)


MEMBERS = "shingle long, class long, size int, place int"


def _several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, size and class: those of shingles with two classes or more, once each. One row is
    what is kept from one batch to the next."""
    names, tail, told = [f.split()[0] for f in MEMBERS.split(", ")], None, False
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(4)]
        if tail is not None:
            cols = [np.concatenate([np.array([t], c.dtype), c]) for t, c in zip(tail, cols)]
        shingle, cls, size = cols[:3]
        # Copies that several tasks have sent are neighbours.
        keep = np.append(True, (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1]) | (size[1:] != size[:-1]))
        cols = [c[keep] for c in cols]
        shingle = cols[0]
        if not len(shingle):
            continue
        like = shingle[1:] == shingle[:-1]
        some = np.append(False, like) | np.append(like, False)
        if tail is not None and told:
            out = some.copy()
            out[0] = False
        else:
            out = some
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols], names)
        told = bool(some[-1]) or (len(shingle) == 1 and tail is not None and told)
        tail = [c[-1] for c in cols]


def members(rows: DataFrame) -> DataFrame:
    """Prefix rows of the shingles that two classes share or more."""
    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "size", "class")
    return dealt.mapInArrow(_several, MEMBERS)


def ranked(shared: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Add `lonely`, the share of its prefix that a class has alone. A class has no more rows than its prefix."""
    own = Window.partitionBy("class", "size")
    prefix = F.col("size") - F.floor((percent * F.col("size") + 99) / 100) + 1
    return shared.withColumn("lonely", ((prefix - F.count(F.lit(1)).over(own)) / F.col("size")).cast("float"))


#: Leaders that a shingle has at once; members that none may link with are left to `open_pairs`.
LEADERS = 4
PAIRS = "a long, a_size int, b long, b_size int"


def _lead(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and loneliness: each member with the first leader that it may link with, and with
    the member before it. The least lonely lead: what a family has in common they have most of. A member without a
    leader becomes one. Pairs that a batch repeats are sent once."""
    shingle, leaders, last = None, [], None
    for b in batches:
        found = set()
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if row[0] != shingle:
                shingle, leaders, last = row[0], [row[1:]], row[1:]
                continue
            own = cls, size, place = row[1:]
            for lead in leaders:
                if may_link(lead[1], lead[2], size, place, percent, min):
                    found.add((lead[:2], own[:2]) if lead[:2] < own[:2] else (own[:2], lead[:2]))
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append(own)
                if last is not None and last is not leaders[-1] and may_link(last[1], last[2], size, place, percent, min):
                    found.add((last[:2], own[:2]) if last[:2] < own[:2] else (own[:2], last[:2]))
            last = own
        if found:
            cols = zip(*((x[0], x[1], y[0], y[1]) for x, y in found if x != y))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["a", "a_size", "b", "b_size"])


def first_pairs(met: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Distinct pairs of classes (a, a_size, b, b_size) to verify first."""
    dealt = met.select("shingle", "class", "size", "place", "lonely").repartition("shingle")
    dealt = dealt.sortWithinPartitions("shingle", "lonely", "size", "class")
    return dealt.mapInArrow(lambda it: _lead(it, percent), PAIRS).distinct()


def _pairs(rows: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """Pairs of classes with their sizes, the lower one as a."""
    x, y = (F.struct(F.col(c).alias("c"), F.col(s).alias("s")) for c, s in (one, two))
    both = rows.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return both.select(F.col("x.c").alias("a"), F.col("x.s").alias("a_size"), F.col("y.c").alias("b"), F.col("y.s").alias("b_size"))


def open_pairs(met: DataFrame, homes: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """All pairs that share a prefix shingle, pass the filters and lie in different components.

    `homes`: class, size and component. Of each shingle only members outside its most frequent component are
    joined with the others, so what is left of a large group makes no pairs of all with all.
    """
    placed = met.join(homes, ["class", "size"])
    main = placed.groupBy("shingle", "home").count().groupBy("shingle").agg(F.max_by("home", F.struct("count", "home")).alias("main"), F.count(F.lit(1)).alias("homes"))
    split = placed.join(main.where("homes > 1").drop("homes"), "shingle")
    part = ("class", "size", "place", "home")
    x = split.where("home <> main").select("shingle", *[F.col(c).alias(f"x_{c}") for c in part])
    y = split.select("shingle", *[F.col(c).alias(f"y_{c}") for c in part])
    long = [F.col(f"{s}_{c}").cast("long") for s in "xy" for c in ("size", "place")]
    met_again = x.join(y, "shingle").where((F.col("x_home") != F.col("y_home")) & may_link(*long, percent, F.least))
    return _pairs(met_again, ("x_class", "x_size"), ("y_class", "y_size")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of edges (low, high) with the least node of their component: node, home.

    Rounds of large star and small star: each node's greater neighbours are moved to its least one, then its lesser
    neighbours are, until every component is a star. Rounds grow with the logarithm of a component's size; each is
    written.
    """
    edges = stored(edges.where("low < high").distinct(), "edges")
    while not _stars(edges):
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lesser, "u")
        small = moved.where("v <> m").select(F.col("m").alias("low"), F.col("v").alias("high")).unionAll(lesser.select(F.col("m").alias("low"), F.col("u").alias("high")))
        edges = stored(small.distinct(), "edges")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("home"))


def _stars(edges: DataFrame) -> bool:
    """Whether no node has an edge both ways, or two to lesser ones."""
    ends = edges.select(F.col("low").alias("node"), F.lit(1).alias("l"), F.lit(0).alias("h")).unionAll(edges.select("high", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.max("l").alias("l"), F.sum("h").alias("h")).where("h > 1 OR (h > 0 AND l > 0)").isEmpty()


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """At most so many elements are shared by two sorted sets: halves about a pivot can share no more than the less of them."""
    if not depth or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(a) + len(b)
    if (100 + percent) * suffix_bound(a, b) < percent * both:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (both - shared)


VERIFIED = "low long, high long"


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int = THRESHOLD) -> DataFrame:
    """The pairs whose texts reach the threshold, as ids of their classes' documents.

    Texts are fetched by id for both sides; both joins use one exchange of the texts. Pairs come out sorted by the
    first side, so that a leader's set is made once for all its pairs in a batch.
    """
    of = classes.select("class", "n_shingles", "rep")
    side = lambda p: of.select(F.col("class").alias(p), F.col("n_shingles").alias(f"{p}_size"), F.col("rep").alias(f"{p}_rep"))
    found = pairs.join(side("a"), ["a", "a_size"]).join(side("b"), ["b", "b_size"])
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    with_b = found.join(texts, found["b_rep"] == texts["_id"]).select("a", "a_rep", "b", "b_rep", F.col("_text").alias("b_text"))
    again = texts.select(F.col("_id").alias("_id2"), F.col("_text").alias("a_text"))
    with_a = with_b.join(again, with_b["a_rep"] == again["_id2"]).select("a", "a_rep", "b", "b_rep", "a_text", "b_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches, STRETCH):
            sides = []
            for c, t in ((0, 4), (2, 5)):
                coded = b.column(t).dictionary_encode()
                s, of = shingled(coded.dictionary), coded.indices.to_numpy()
                # If an id repeats, its other texts come too: only that of the class counts.
                sides.append((s.sets, of, _signed(s.keys)[of] == b.column(c).to_numpy()))
            (xs, x, x_own), (ys, y, y_own) = sides
            out = [i for i in np.nonzero(x_own & y_own)[0] if linked(xs[x[i]], ys[y[i]], percent)]
            if out:
                p, q = b.column(1).to_numpy()[out], b.column(3).to_numpy()[out]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["low", "high"])

    return with_a.mapInArrow(run, VERIFIED)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """Every row's id, n_shingles and component_id: the smallest id that links lead to, its own included.

    Keys are numbers; rows of one key are one document for linking, and each has its row. A null key takes the
    component of its class, if another row of that class has a key, else null. Null texts and texts without words
    have no shingles, link with nothing and are components of their own. An empty table gives an empty one. Only the
    key and the text are read.
    """
    rows, counts = survey(docs, key, text)
    classes = stored(rows.where("n_shingles > 0").groupBy("class", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    met = stored(ranked(members(prefixes(docs, text, counts, percent)), percent), "meetings")
    tried = stored(first_pairs(met, percent), "pairs")
    links = stored(verified(tried, classes, docs, key, text, percent), "links")
    homes = components(links)
    of = classes.join(homes, classes["rep"] == homes["node"], "left").select("class", F.col("n_shingles").cast("int").alias("size"), F.coalesce("home", "rep").alias("home"))
    more = open_pairs(met, of, percent).join(tried, ["a", "a_size", "b", "b_size"], "left_anti")
    rest = stored(verified(more, classes, docs, key, text, percent), "links")
    if not rest.isEmpty():
        homes = components(links.unionAll(rest))
    found = classes.join(homes, classes["rep"] == homes["node"], "left").select("class", "n_shingles", F.coalesce("home", "rep").alias("_home"))
    return rows.join(found, ["class", "n_shingles"], "left").select("id", "n_shingles", F.coalesce("_home", "id").alias("component_id"))
