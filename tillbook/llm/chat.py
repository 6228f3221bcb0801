"""Chat formatting of logged conversations, without snapshots that longer ones contain.

A log often holds a conversation several times, each time with more turns. Hashes of
all turn prefixes are running sums; a conversation whose hash is that of a proper prefix
of another is dropped by an anti join, and the rest are rendered. Column expressions,
windows and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.staging import staged

# Turns whose numbers fall in one block are ordered, summed and rendered together, so
# that a conversation of any length is never in one task.
BLOCK = 1024


def turn_hash(seed: int) -> Column:
    """Hash of a turn and its place; NULLs differ from empty strings."""
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv, conv_id, block, place, role, text, h1, h2``: turns with their places from 1
    and the sums of two hashes over the turns up to them."""
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    turns = turns.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    turns = staged(turns.withColumn("place", F.row_number().over(inside).cast("long")), "chat-turns")
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    turns = turns.join(offsets, ["conv", "block"]).withColumn("place", F.col("place") + F.col("offset")).drop("offset")
    turns = staged(turns.withColumns({"h1": turn_hash(1), "h2": turn_hash(2)}), "chat-places")
    sums = turns.groupBy("conv", "block").agg(F.sum("h1").alias("b1"), F.sum("h2").alias("b2"))
    sums = sums.select("conv", "block", *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).cast("decimal(38,0)").alias(b) for b in ("b1", "b2")])
    running = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.join(sums, ["conv", "block"])
    return turns.withColumns({h: (F.col(b) + F.sum(h).over(running)).cast("decimal(38,0)") for h, b in (("h1", "b1"), ("h2", "b2"))}).drop("b1", "b2")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv`` of the conversations that no other one continues; of equal ones, the one
    with the least id, ids compared as numbers where they are."""
    last = staged(turns.groupBy("conv").agg(F.max("place").alias("place")), "chat-last")
    ends = turns.join(last, ["conv", "place"]).select("conv", "conv_id", "place", "h1", "h2")
    ends = staged(ends.groupBy("place", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "conv")).alias("c")).select("c.conv", "place", "h1", "h2"), "chat-ends")
    proper = turns.join(last.withColumnRenamed("place", "n"), "conv").filter("place < n").select("place", "h1", "h2").distinct()
    return ends.join(proper, ["place", "h1", "h2"], "left_anti").select("conv")


def formatted(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``conv_id, part, n_turns, text``: maximal conversations, rendered.

    A turn reads ``begin role newline text end newline``; begin and end marks inside a
    role or text lose their first character, so that no turn can pose as another. Turns
    are ordered by number, NULL first, then by role and text; repeated rows count once.
    NULL ids are one conversation, a NULL role reads ``unknown``, a NULL text is empty.
    Part 0 has the turns numbered below 1024, part 1 the next 1024, and so on (-1 without
    a number); an empty table gives no rows.
    """
    turns = staged(numbered(conversations), "chat-numbered")
    kept = turns.join(staged(maximal(turns), "chat-kept"), "conv", "left_semi")
    plain = lambda c, none: F.replace(F.replace(F.coalesce(F.col(c), F.lit(none)), F.lit(begin), F.lit(begin[1:])), F.lit(end), F.lit(end[1:]))
    line = F.concat(F.lit(begin), plain("role", "unknown"), F.lit("\n"), plain("text", ""), F.lit(f"{end}\n"))
    texts = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return (
        kept.groupBy("conv_id", "block")
        .agg(F.count("*").alias("n_turns"), texts.alias("lines"))
        .select("conv_id", F.col("block").cast("long").alias("part"), "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
    )
