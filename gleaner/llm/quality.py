"""Quality rules as a cascade that stops at the first rejection, in an order learned from a sample.

A rule is a measure of the text and a limit. Rules are run on a bounded sample first: its rejections give each
rule's selectivity, its running time on the sample the cost. Rules go by rejections per cost, and a CASE tries
them in that order, so most bad rows are dropped by a cheap rule and never reach the dear ones. The order changes
the work, never the verdict. Only DataFrame functions: no Python on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words(text: Column) -> Column:
    """The words of a text, an array; null has none. Words are runs of anything but the six ASCII spaces."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once: a lambda's argument is, an expression inside a lambda is not."""
    return F.transform(F.array(value), use)[0]


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)


def duplicate_lines(lines: Column) -> Column:
    return _let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def _windows(ws: Column, make: Callable[[Column, Column], Column]) -> Column:
    last = F.size(ws) - (WINDOW - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), lambda i: make(ws, i)))


def window_hashes(ws: Column) -> Column:
    """A 64-bit hash of every window; null with fewer words than a window. Equal windows have equal hashes."""
    return _let(ws, lambda ws: _windows(ws, lambda ws, i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)])))


def repeated_words(ws: Column, hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more in the text.

    If all hashes differ, all windows do. Else the windows themselves, sorted beside their places, tell which
    repeat; the union of their stretches is summed over the sorted places.
    """
    window = lambda ws, i: F.struct(F.slice(ws, i + 1, WINDOW).alias("w"), i.alias("at"))
    exact = lambda ws: _let(F.array_sort(_windows(ws, window)), lambda o: _covered(_repeats(o)))
    alone = _let(hashes, lambda h: F.coalesce(F.size(h) == F.size(F.array_distinct(h)), F.lit(True)))
    return F.when(alone, F.lit(0).cast("long")).otherwise(_let(ws, exact))


def _repeats(ordered: Column) -> Column:
    """Places of those of the sorted windows that equal a neighbour, ascending."""
    like = lambda x, j: F.coalesce(F.get(ordered, j)["w"] == x["w"], F.lit(False))
    hit = F.filter(ordered, lambda x, j: like(x, j - 1) | like(x, j + 1))
    return F.array_sort(F.transform(hit, lambda x: x["at"]))


def _covered(places: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    add = lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last"))
    return F.aggregate(places, start, add, lambda a: a["sum"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word), of the whole text.

    A null text has no words, lines or symbols. Work is n log n in a text's words, inside its own row: no shuffle. All
    other columns are kept; the new names must be free.
    """
    if clash := set(MEASURES) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    t = F.col("_text")
    # Each step is a projection of its own, so that the words and hashes of a text are made once. The row itself goes
    # along whole, so its own names cannot meet those of the steps.
    return (
        docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
        .withColumn("_words", words(t))
        .withColumn("_hashes", window_hashes(F.col("_words")))
        .withColumn("_lines", lines(t))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", word_chars(t))
        .withColumn("n_symbols", symbols(t))
        .withColumn("n_dup_lines", duplicate_lines(F.col("_lines")))
        .withColumn("n_repeat_words", repeated_words(F.col("_words"), F.col("_hashes")))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .select("_row.*", *MEASURES)
    )


def sample_of(docs: DataFrame, rows: int = 2000, seed: int = 7) -> DataFrame:
    """About `rows` rows drawn from the whole table; all of a smaller table. It steers the order of rules only."""
    return docs.sample(False, min(1.0, rows / max(1, docs.count())), seed)


@dataclass(frozen=True)
class Rule:
    """Rejects a row where `rejects` is true; null does not reject."""

    name: str
    rejects: Column


def ordered(sample: DataFrame, rules: Sequence[Rule], clock: Callable[[], float] = time.perf_counter, runs: int = 3) -> list[Rule]:
    """Rules by rejections per second on a sample, the best first.

    Hand over a stored sample that has the very columns the rules will read. Each rule, and a bare scan, is timed
    `runs` times and its least time counts; what it takes beyond the bare scan is its cost, but no less than the
    spread of the bare scans, as less cannot be told from noise. So rules that read ready columns cost alike and go by
    rejections. Rules alike keep their given order.
    """
    if not rules:
        return []

    def timed(rule: Rule | None) -> tuple[list[float], int]:
        took, hits = [], 0
        for _ in range(runs):
            began = clock()
            hits = sample.agg(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long")) if rule else F.count(F.lit(1))).first()[0] or 0
            took.append(clock() - began)
        return took, hits

    timed(None)  # warms up
    base, _ = timed(None)
    floor = max(max(base) - min(base), 1e-3)
    found = []
    for k, rule in enumerate(rules):
        took, hits = timed(rule)
        found.append((-hits / max(min(took) - min(base), floor), k, rule))
    return [rule for _, _, rule in sorted(found, key=lambda x: x[:2])]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the row, in the given order; null if all pass.

    A CASE: later rules are not evaluated for a row that is rejected.
    """
    out = None
    for rule in rules:
        hit = F.coalesce(rule.rejects, F.lit(False))
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def text_rules(text: str = "text", have: dict[str, Column] | None = None) -> list[Rule]:
    """The standing rules on a text alone.

    Limits reject plain junk and leave unusual prose alone: a symbol in one word of four; more than half of the
    lines seen before; words of 2.5 to 12 letters on average; letters under 45 % of what is not a space; capitals
    over 60 % of the letters. `have` gives measures that the row has already, such as those of `measured`; the
    others are made where a rule needs them, only for rows that come so far.
    """
    t, have = F.coalesce(F.col(text), F.lit("")), have or {}
    n = have.get("n_words", F.size(words(t)))
    chars = have.get("word_chars", word_chars(t))
    marks = have.get("n_symbols", symbols(t))
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    capitals = F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    ls = have.get("n_lines", F.size(lines(t)))
    doubled = have.get("n_dup_lines", duplicate_lines(lines(t)))
    return [
        Rule("symbols", 4 * marks > n),
        Rule("duplicate_lines", 2 * doubled > ls),
        Rule("word_length", (2 * chars < 5 * n) | (chars > 12 * n)),
        Rule("letters", 100 * letters < 45 * chars),
        Rule("capitals", 100 * capitals > 60 * letters),
    ]


def base_rules(text: str = "text", have: dict[str, Column] | None = None) -> list[Rule]:
    """Fewer than 10 words, or over 20 % of the words in repeated windows."""
    if have:
        return [Rule("short", have["n_words"] < 10), Rule("repeats", 100 * have["n_repeat_words"] > 20 * have["n_words"])]
    ws = words(F.col(text))
    return [
        Rule("short", F.size(ws) < 10),
        Rule("repeats", _let(ws, lambda ws: 100 * repeated_words(ws, window_hashes(ws)) > 20 * F.size(ws))),
    ]


def measures() -> dict[str, Column]:
    """The columns that `measured` adds, as rules take them."""
    return {k: F.col(k) for k in MEASURES}
