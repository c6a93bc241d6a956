"""Repair of conversations: the cheapest edits that make the roles alternate, decided by one integer minimum.

A path of edits weighs one big integer. Its high digits are the cost; below them come as many digits of 256 as a path
can have letters, the initials of its edits in order and zeros behind the last. So the least integer is the least
cost, and among equals the audit that is first in ASCII. An edit put before a path adds its cost at the top and moves
the letters one place down, into the padding. Edits before, from and to each state make a DAG, and a minimum over its
edges is all that decides.

Conversations of any length are cut into blocks of turns. A block gives the best path between any two states; a
conversation's blocks are put together from the last to the first, letters behind letters. Two paths of equal cost
through the same rows never have audits of which one begins the other (the longer has an insert more), so the best
path of a block stays the best whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.ordered import numbered
from gleaner.session import stored

# What a kept or new row does to the state, by the initial of its role. Nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
# Codes of rows: the initial of a role (x: any other), in capitals if the text is cut short; - must be deleted.
MUST_GO = "-"
# Nothing but these is blank.
BLANK = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Costs:
    """Of a row's edits; a kept row is free. `truncated` is added to a row cut short that stays. An insert must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _before(cost: int, letter: str, path: int, digits: int) -> int:
    """The weight of a path with an edit put before it."""
    low = path & ((1 << 8 * digits) - 1)
    return path - low + (cost << 8 * digits) + (ord(letter) << 8 * (digits - 1)) + (low >> 8)


def _with_inserts(paths: list[int | None], costs: Costs, digits: int) -> list[int | None]:
    """Up to two new rows before the paths from each state. A third would make a pair that can go for less."""
    best = paths
    for _ in range(2):
        more = [[_before(costs.insert, INSERT, p, digits) for r in ROLES if (t := NEXT.get((s, r))) is not None and (p := best[t]) is not None] for s in range(4)]
        best = [min((p for p in (paths[s], *more[s]) if p is not None), default=None) for s in range(4)]
    return best


def _edits(code: str, state: int, costs: Costs) -> Iterator[tuple[int, str, int]]:
    """Cost, letter and next state of all edits of a row."""
    yield costs.delete, DELETE, state
    if code == MUST_GO:
        return
    role, extra = code.lower(), costs.truncated if code.isupper() else 0
    if (to := NEXT.get((state, role))) is not None:
        yield extra, KEEP, to
    for r in ROLES:
        if r != role and (to := NEXT.get((state, r))) is not None:
            yield extra + costs.rerole, REROLE, to


def _opened(weight: int, digits: int) -> tuple[int, str]:
    low = weight & ((1 << 8 * digits) - 1)
    return weight >> 8 * digits, low.to_bytes(digits, "big").rstrip(b"\0").decode()


def block_paths(codes: str, costs: Costs) -> list[tuple[int, int, int, str]]:
    """The best path through some rows between any two states: from, to, cost, letters. Inserts come before rows."""
    digits = 3 * len(codes) + 1
    out = []
    for end in range(4):
        best: list[int | None] = [0 if s == end else None for s in range(4)]
        for code in reversed(codes):
            best = [min((_before(c, x, p, digits) for c, x, t in _edits(code, s, costs) if (p := best[t]) is not None), default=None) for s in range(4)]
            best = _with_inserts(best, costs, digits)
        out += [(s, end, *_opened(p, digits)) for s, p in enumerate(best) if p is not None]
    return out


def _joined(cost: int, letters: str, path: int, digits: int, more: int) -> int:
    """A block's letters put before a path of `digits` digits; the weight then has `digits + more`."""
    low = path & ((1 << 8 * digits) - 1)
    own = int.from_bytes(letters.encode(), "big")
    room = digits + more
    return (((path >> 8 * digits) + cost) << 8 * room) + (own << 8 * (room - len(letters))) + (low << 8 * (more - len(letters)))


def decide(blocks: list[list[tuple[int, int, int, str]]], costs: Costs) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost, audit, and for each block the state it begins in and its letters; the last entry is what is put after all rows."""
    digits = 2
    best = _with_inserts([0 if s in FINAL else None for s in range(4)], costs, digits)
    ways: list[list[list[tuple[int, str]] | None]] = []
    for paths in reversed(blocks):
        more = max((len(p[3]) for p in paths), default=0)
        new, way = [None] * 4, [None] * 4
        for s, t, cost, letters in paths:
            if best[t] is None:
                continue
            weight = _joined(cost, letters, best[t], digits, more)
            if new[s] is None or weight < new[s]:
                new[s], way[s] = weight, (t, letters)
        best, digits = new, digits + more
        ways.append(way)
    cost, audit = _opened(best[START], digits)
    state, steps, used = START, [], 0
    for way in reversed(ways):
        to, letters = way[state]
        steps.append((state, letters))
        state, used = to, used + len(letters)
    return cost, audit, [*steps, (state, audit[used:])]


def expand(state: int, letters: str, initials: str) -> Iterator[tuple[int | None, str, str | None]]:
    """For each letter of a block: which of its rows (null: none), the edit, and a new role (null: its own)."""
    at = 0
    for x in letters:
        row = None if x == INSERT else at
        at += x != INSERT
        if x == DELETE:
            yield row, x, None
            continue
        role = initials[row] if x == KEEP else next(r for r in ROLES if (state, r) in NEXT)
        state = NEXT[state, role]
        yield row, x, None if x == KEEP else ROLES[role]


_PATH = "array<struct<s: int, t: int, cost: bigint, letters: string>>"
_STEP = "array<struct<block: bigint, state: int, letters: string, initials: string, seq: bigint>>"


@dataclass(frozen=True)
class Repair:
    """`conversations`: one row each. `turns`: the rows that stay, and the new ones, in the order of `seq`."""

    conversations: DataFrame
    turns: DataFrame


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, blocks: int | None = None) -> DataFrame:
    """Rows in order within their conversation: conv_id, n (from 1), turn, role, text, and code for its first fault.

    Rows go by turn (nulls first), role, first 32 code points of the text and then its digest, so rows of one turn have
    a defined order and repeated rows stand side by side.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumns({"_head": F.substring("text", 1, 32), "_digest": F.sha2("text", 256), "_tie": F.monotonically_increasing_id()})
    rows = stored(numbered(rows, ["conv_id"], ["turn", "role", "_head", "_digest", "_tie"], "n", blocks).drop("_head", "_tie"), "turns")
    # One row for each text of a role; the many rows of one text are counted before they are shuffled.
    firsts = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_digest").alias("_text")).agg(F.min("n").alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_text"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANK[1:]}"), "blank")
        .when(F.col("n") > F.col("_first"), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?]{BLANK}*\z"), "truncated")
    )
    return (
        rows.join(firsts, same)
        .select("conv_id", "n", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"))
        .withColumn("code", F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
    )


def repaired(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    costs: Costs = Costs(), block: int = 512, blocks: int | None = None,
) -> Repair:
    """Repair every conversation.

    A row is blank if its text has nothing but ASCII white space, else a duplicate if its role and text came earlier
    in the conversation, else truncated if what it ends with (white space aside) is no `.`, `!` or `?`. Blank rows and
    duplicates are deleted; other rows are kept, get another role or are deleted, and rows without text are put in,
    so that the roles' initials are nothing, or one system row at most and then pairs of user and assistant.

    `conversations`: conv_id, gaps (turn numbers that are missing between the least and the greatest), blank,
    duplicate, truncated, illegal (neighbours whose initials are not su, ua or au), cost, audit. `turns`: conv_id, seq
    (from 1 over all edits), turn, edit, role, text of the rows that are not deleted.

    Null conversation ids are one conversation. A null role or text is empty. Null turns come first and make no gap.
    Rows of one turn go by role and text as `numbered_turns` says; repeated rows are rows of their own. Columns other
    than the four named are not read. An empty table gives empty frames.

    Work is cut into `block` rows, however many a conversation has. An audit is one string, so a conversation's
    letters, a byte for each row, do meet in one row; its texts never do.
    """
    if costs.insert <= 0:
        raise ValueError("an insert must cost something")
    rows = stored(numbered_turns(turns, conv, turn, role, text, blocks), "faults")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    word = lambda c: F.array_join(F.transform("_rows", lambda r: r[c]), "").alias(c)
    cut = (
        rows.groupBy("conv_id", F.floor((F.col("n") - 1) / block).alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "code", "initial"))).alias("_rows"),
            F.min("turn").alias("least"), F.max("turn").alias("most"), F.size(F.collect_set("turn")).cast("long").alias("distinct"),
            count("blank"), count("duplicate"), count("truncated"),
        )
        .select("conv_id", "block", word("code"), word("initial"), "least", "most", "distinct", "blank", "duplicate", "truncated")
    )

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        kind = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
        for b in batches:
            out = []
            for codes in b.column(b.schema.get_field_index("code")).to_pylist():
                got = known.get(codes)
                if got is None:
                    got = [dict(zip(("s", "t", "cost", "letters"), p)) for p in block_paths(codes, costs)]
                    if len(codes) <= 12 and len(known) < 20_000:
                        known[codes] = got
                out.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "paths"])

    with_paths = cut.mapInArrow(paths, T.StructType([*cut.schema.fields, T.StructField("paths", T._parse_datatype_string(_PATH))]))
    whole = with_paths.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "initial", "least", "most", "distinct", "paths"))).alias("_blocks"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
    )

    step = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("letters", pa.string()), ("initials", pa.string()), ("seq", pa.int64())]))
    added = [("gaps", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("_steps", step)]

    def decided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                out = [_decided(blocks, costs) for blocks in b.column(b.schema.get_field_index("_blocks")).to_pylist()]
                cols = [pa.array([o[k] for o in out], kind) for k, (_, kind) in enumerate(added)]
                keep = [n for n in b.schema.names if n != "_blocks"]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in keep], *cols], [*keep, *[n for n, _ in added]])

    fields = [f for f in whole.schema.fields if f.name != "_blocks"]
    new = T._parse_datatype_string(f"gaps bigint, illegal bigint, cost bigint, audit string, _steps {_STEP}").fields
    done = stored(whole.mapInArrow(decided, T.StructType([*fields, *new])), "decided")

    key = next(f for f in done.schema.fields if f.name == "conv_id")
    steps = done.select("conv_id", F.explode("_steps").alias("_s")).select("conv_id", "_s.*")

    def expanded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("conv_id"))
            for i, r in enumerate(b.drop_columns(["conv_id"]).to_pylist()):
                got = list(expand(r["state"], r["letters"], r["initials"]))
                take = pa.array([i] * len(got), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        pa.array([r["seq"] + k for k in range(len(got))], pa.int64()),
                        pa.array([None if at is None else r["block"] * block + at + 1 for at, _, _ in got], pa.int64()),
                        pa.array([x for _, x, _ in got], pa.string()),
                        pa.array([o for _, _, o in got], pa.string()),
                    ],
                    ["_conv", "seq", "_n", "edit", "_new"],
                )

    edit = [T.StructField("_conv", key.dataType), *T._parse_datatype_string("seq bigint, _n bigint, edit string, _new string").fields]
    edits = steps.mapInArrow(expanded, T.StructType(edit)).where(F.col("edit") != DELETE)
    same = F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_n") == F.col("n"))
    made = edits.join(rows.select("conv_id", "n", "turn", "role", "text"), same, "left").select(
        F.col("_conv").alias("conv_id"), "seq", "turn", "edit", F.coalesce("_new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return Repair(done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), made)


def _decided(blocks: list[dict], costs: Costs) -> tuple:
    cost, audit, steps = decide([[(p["s"], p["t"], p["cost"], p["letters"]) for p in b["paths"]] for b in blocks], costs)
    legal = ("su", "ua", "au")
    illegal = sum(b["initial"][i : i + 2] not in legal for b in blocks for i in range(len(b["initial"]) - 1))
    illegal += sum(a["initial"][-1] + b["initial"][0] not in legal for a, b in zip(blocks, blocks[1:]))
    turned = [b for b in blocks if b["least"] is not None]
    distinct = sum(b["distinct"] for b in turned) - sum(a["most"] == b["least"] for a, b in zip(turned, turned[1:]))
    gaps = turned[-1]["most"] - turned[0]["least"] + 1 - distinct if turned else 0
    out, seq = [], 1
    for at, (state, letters) in enumerate(steps):
        own = blocks[at]["block"] if at < len(blocks) else len(blocks)
        if letters:
            out.append({"block": own, "state": state, "letters": letters, "initials": blocks[at]["initial"] if at < len(blocks) else "", "seq": seq})
        seq += len(letters)
    return gaps, illegal, cost, audit, out


def digests(turns: DataFrame, conv: str, order: str, piece: str, between: str = "\n") -> DataFrame:
    """conv, digest: SHA-256 of a conversation's pieces in order with `between` between them.

    Each conversation is a stream through one task, which holds its hash and one batch, never its text.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(order).alias("_at"), F.col(piece).alias("_piece"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_at").select("conv_id", "_piece")
    key = rows.schema["conv_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, kind = None, None, None
        for b in batches:
            kind = b.schema.field("conv_id").type
            out = []
            ids, pieces = b.column(0).to_pylist(), b.column(1)
            for i, k in enumerate(ids):
                if sha is None or k != last:
                    if sha is not None:
                        out.append((last, sha.hexdigest()))
                    last, sha = k, hashlib.sha256()
                else:
                    sha.update(between.encode())
                sha.update(pieces[i].as_py().encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([d for _, d in out], pa.string())], ["conv_id", "digest"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "digest"])

    return rows.mapInArrow(run, T.StructType([key, T.StructField("digest", T.StringType())]))
