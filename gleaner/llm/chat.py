"""Perspective rotation: a dialogue of several parties, rendered once for each of them.

In a perspective its speaker is the assistant and the others are users with a name; system turns stay
system turns. The loss mask covers what the assistant says, with the end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Turns are summed in blocks of so many turn numbers, so that a huge dialogue is many tasks' work.
BLOCK = 512


def _plain(text: Column) -> Column:
    """Marks within a text lose their meaning."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column, name: Column) -> Column:
    # A name stays on its line, and can neither close the head nor open another.
    shown = _plain(F.translate(name, "\n\r\x0b\x0c\x85\u2028\u2029", " " * 7))
    named = F.when(role == "user", F.concat(F.lit(" name="), shown)).otherwise(F.lit(""))
    return F.concat(F.lit(OPEN), role, named, F.lit("\n"))


def rotated(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
            system: str = "system") -> DataFrame:
    """One row for each turn and perspective: conv, perspective, turn, role, piece, start, loss_start, loss_end.

    `start` is the place of the piece in the whole rendering, `loss_start` and `loss_end` are places in the piece
    (null: no loss). All count code points.

    A null speaker is the participant `unknown`; a null text is empty; null dialogue ids are one dialogue. A
    dialogue of system turns only has no perspective and gives no row. Turns are taken in the order of number
    (nulls first), speaker, text; repeated rows are kept. Marks within a text or a shown name lose their meaning: `<|`
    becomes `< |`, and line ends in a shown name become spaces. Columns other than the four named are not read.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("name"),
        _plain(F.coalesce(F.col(text), F.lit(""))).alias("said"),
    )
    parties = said.where(F.col("name") != system).select(F.col("conv_id").alias("_conv"), F.col("name").alias("perspective")).distinct()
    role = F.when(F.col("name") == system, F.lit("system")).when(F.col("name") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    rows = (
        said.join(parties, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("role", role)
        .withColumn("_head", _head(F.col("role"), F.col("name")))
        .withColumn("piece", F.concat("_head", "said", F.lit(CLOSE + "\n")))
        .withColumn("_n", F.char_length("piece").cast("long"))
        .withColumn("_block", F.floor(F.col("turn") / BLOCK))
    )
    # Sums within blocks, then over the blocks of a dialogue.
    within = Window.partitionBy("conv_id", "perspective", "_block").orderBy("turn", "name", "said").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("conv_id").alias("_conv2"), F.col("perspective").alias("_of"), F.col("_block").alias("_b")).agg(F.sum("_n").alias("_total"))
    over = Window.partitionBy("_conv2", "_of").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("_conv2", "_of", "_b", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    loss = F.col("role") == "assistant"
    return (
        rows.drop("_conv")
        .withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(base, F.col("conv_id").eqNullSafe(F.col("_conv2")) & (F.col("perspective") == F.col("_of")) & F.col("_block").eqNullSafe(F.col("_b")))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "role",
            "piece",
            (F.col("_base") + F.col("_in")).alias("start"),
            F.when(loss, F.char_length("_head").cast("long")).alias("loss_start"),
            F.when(loss, F.col("_n") - 1).alias("loss_end"),
        )
    )


def rendered(pieces: DataFrame, part_chars: int = 65536) -> DataFrame:
    """Put the pieces of `rotated` together: conv_id, perspective, part, start, text, n_turns, loss (spans in text).

    A rendering is one row unless it is longer than `part_chars`: then it is cut between turns, and a part holds
    the turns that begin in its stretch of the rendering. So a row never holds more than `part_chars` and one
    turn, and nothing is left out.
    """
    spans = F.transform(
        F.filter("_turns", lambda t: t["loss_start"].isNotNull()),
        lambda t: F.struct(
            (t["start"] - F.col("start") + t["loss_start"]).alias("start"), (t["start"] - F.col("start") + t["loss_end"]).alias("end")
        ),
    )
    return (
        pieces.groupBy("conv_id", "perspective", F.floor(F.col("start") / part_chars).cast("long").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "piece", "loss_start", "loss_end"))).alias("_turns"))
        .withColumn("start", F.col("_turns")[0]["start"])
        .select(
            "conv_id",
            "perspective",
            "part",
            "start",
            F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("text"),
            F.size("_turns").cast("long").alias("n_turns"),
            spans.alias("loss"),
        )
    )
