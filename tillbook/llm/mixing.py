"""Mixing sources to target weights by hash thresholds.

A document's place is a hash of its id and text, a number below 2**60. Documents
below a source's threshold are taken, so nobody sorts: words are summed by source
and bucket of places, the bucket where the budget runs out is found, and only the
documents of that bucket are counted again, by finer buckets. Rows that repeat both id and
text share a place; where a threshold falls on them, as many of them as fit are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import PLAIN_WORD
from tillbook.operators.staging import staged

BITS, STEP = 60, 10
# Repeated rows that are dealt out at a time.
RUN = 4096


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, place`` of every document; the only pass over the texts.

    A NULL text has size 0. Rows that repeat both id and text share a place.
    """
    return docs.select(
        "doc_id",
        "source",
        _size().alias("size"),
        _place().alias("place"),
    )


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def _place() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 64 - BITS)


def weighted_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source, source_size, target``: the total of all sizes shared out by weight.

    Sources in code point order, NULL last, have the weights in turn, repeating. A
    target stops at ``most`` times its source's size; the excess goes to the others
    by weight until none is above. With sources ordered by the share at which they
    stop, the final share per unit of weight is the largest of those that arise when
    the first 0, 1, 2, ... have stopped. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    shares = totals.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shares = shares.withColumn("unit", left / heavy)
    shares = shares.withColumn("unit", F.max("unit").over(everyone))
    return shares.select("source", "source_size", F.least("stop", F.col("unit") * F.col("weight")).alias("target"))


def thresholds(places: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, budget, below``: the largest threshold under which at most ``budget`` words lie.

    ``places`` has ``source, size, place``. A source may have several budgets; a
    smaller one never has the larger threshold, so their selections are nested.
    """
    open_ends = staged(
        budgets.select("source", "budget", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(2).cast("long").alias("docs")),
        "mix-ends",
    )
    for depth in range(1, BITS // STEP + 1):
        outer, inner = BITS - STEP * (depth - 1), BITS - STEP * depth
        wanted = open_ends.filter("docs > 1").select(F.col("source").alias("of"), F.col("prefix").alias("within")).distinct()
        buckets = (
            places.withColumn("prefix", F.shiftright("place", outer))
            .join(wanted, F.col("source").eqNullSafe(F.col("of")) & (F.col("prefix") == F.col("within")), "left_semi")
            .groupBy("source", "prefix", F.shiftright("place", inner).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        )
        grown = F.sum("words").over(Window.partitionBy("source", "prefix").orderBy("bucket"))
        buckets = buckets.withColumn("until", grown).select(F.col("source").alias("of"), F.col("prefix").alias("within"), "bucket", "words", "rows", "until")
        # The first bucket that the budget does not cover; none: the next prefix is the end.
        reached = (
            open_ends.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("prefix") == F.col("within")), "left")
            .groupBy("source", "budget", "left", "prefix", "docs")
            .agg(F.min(F.when(F.col("until") > F.col("left"), F.struct("bucket", "words", "rows", "until"))).alias("at"))
        )
        refined = F.col("docs") > 1
        after = F.shiftleft(F.col("prefix") + 1, STEP)
        open_ends = staged(
            reached.select(
                "source",
                "budget",
                F.when(refined & F.col("at").isNotNull(), F.col("left") - F.col("at.until") + F.col("at.words")).otherwise(F.col("left")).alias("left"),
                F.when(~refined, F.shiftleft("prefix", STEP)).otherwise(F.coalesce("at.bucket", after)).alias("prefix"),
                F.when(refined, F.coalesce("at.rows", F.lit(0))).otherwise(F.col("docs")).alias("docs"),
            ),
            "mix-ends",
        )
        if open_ends.filter("docs > 1").isEmpty():
            break
    return open_ends.select("source", "budget", F.shiftleft("prefix", inner).alias("below"))


def planned(sizes: DataFrame, weights: tuple[float, ...], most: float, near: float) -> DataFrame:
    """``of, source_size, target, whole, rounds`` of every source ``of``.

    A source is read whole ``whole`` times, and once more below its threshold. What
    the threshold's last document leaves over is filled by a further threshold among
    the documents that still fit, and so on until at most ``near`` of the target is
    missing or nothing fits; no source exceeds its target. Of the rows that share the place
    of a threshold, a round takes ``copies``; the others no longer fit.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plans = weighted_targets(sizes, weights, most).withColumn("whole", whole)
    plans = plans.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plans = staged(plans.withColumn("rounds", F.expr("cast(array() as array<struct<below: bigint, limit: bigint, copies: bigint>>)")), "mix-plans")
    short = (F.col("rest") > 0) & (F.col("rest") > F.col("target") * near)
    while not (lacking := plans.filter(short)).isEmpty():
        free = (
            sizes.join(lacking.select(F.col("source").alias("of"), "rest", "rounds"), F.col("source").eqNullSafe(F.col("of")))
            .filter((F.col("size") > 0) & (F.col("size") <= F.col("rest")) & ~_chosen())
            .select("source", "size", "place")
        )
        free = staged(free, "mix-free")
        if free.isEmpty():
            break
        ends = thresholds(free, lacking.select("source", F.col("rest").alias("budget"))).select(F.col("source").alias("of"), "below")
        at, under = F.col("place") == F.col("below"), F.col("place") < F.col("below")
        gained = (
            free.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("place") <= F.col("below")))
            .groupBy("of")
            .agg(F.sum(F.when(under, F.col("size")).otherwise(0)).alias("gained"), F.count(F.when(at, 1)).alias("rows"), F.max(F.when(at, F.col("size"))).alias("size"))
        )
        before = plans
        plans = before.join(gained, F.col("source").eqNullSafe(F.col("of")), "left").join(ends.withColumnRenamed("of", "from"), F.col("source").eqNullSafe(F.col("from")), "left")
        gain = F.coalesce("gained", F.lit(0))
        plans = plans.withColumn("copies", F.coalesce(F.least(F.col("rows"), F.floor((F.col("rest") - gain) / F.col("size"))), F.lit(0)))
        plans = plans.withColumn("gained", gain + F.col("copies") * F.coalesce("size", F.lit(0)))
        step = F.array(F.struct("below", F.col("rest").alias("limit"), "copies"))
        plans = plans.withColumn("rounds", F.when(F.col("gained") > 0, F.concat("rounds", step)).otherwise(F.col("rounds")))
        plans = plans.withColumn("rest", F.when(F.col("gained") == 0, F.lit(0)).otherwise(F.col("rest") - F.col("gained")))
        plans = staged(plans.select(before.columns), "mix-plans")
    return plans.withColumnRenamed("source", "of").drop("rest")


def _chosen() -> Column:
    """Whether one of the source's rounds takes the document once more."""
    return F.exists("rounds", lambda r: (F.col("place") < r["below"]) & (F.col("size") <= r["limit"]))


def _copies() -> Column:
    """How many rows of the document's place a round takes that ends there."""
    held = lambda r: (F.col("place") == r["below"]) & (F.col("size") <= r["limit"])
    return F.aggregate("rounds", F.lit(0).cast("long"), lambda n, r: n + F.when(held(r), r["copies"]).otherwise(0))


def counted(rows: DataFrame, plans: DataFrame, own: list[str]) -> DataFrame:
    """``own`` columns, ``source_size``, ``target`` and ``times`` of every row.

    Rows of a place at which a round ends are collapsed to one per kind, on the map side
    first, and numbered by running counts; no task sees all rows of a large group.
    """
    found = rows.join(plans, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", F.col("whole") + _chosen().cast("long"))
    columns = [*own, "source_size", "target", "times"]
    if plans.filter(F.exists("rounds", lambda r: r["copies"] > 0)).isEmpty():
        return found.select(columns)
    found = found.withColumn("copies", F.when(_chosen(), F.lit(0)).otherwise(_copies()))
    kinds = found.filter("copies > 0").groupBy("of", "place", "copies", *columns).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("of", "place").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    runs = kinds.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    dealt = runs.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, last)))
    dealt = dealt.withColumn("times", F.col("times") + (F.col("ahead") + F.col("i") < F.col("copies")).cast("long"))
    return found.filter("copies = 0").select(columns).unionByName(dealt.select(columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, near: float = 0.002) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` of every row; ``taken`` is the
    number of words that the mix takes of a document, repeats counted.

    NULL is a source like others. Empty documents and sources without words take
    nothing; an empty table gives none.
    """
    sizes = staged(sized(docs), "mix-sizes")
    plans = planned(sizes, weights, most, near)
    return counted(sizes, plans, ["doc_id", "size", "source"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source"
    )


def drawn(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, near: float = 0.002) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as ``row``, with ``times`` and ``taken``.

    Only the thresholds, one row per source, meet the texts: nothing is sorted or shuffled
    but rows of a place that a threshold divides.
    """
    plans = planned(staged(sized(docs), "mix-sizes"), weights, most, near)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, "source", _size().alias("size"), _place().alias("place"))
    taken = counted(own, plans, ["row", "size"]).select("row", "times", (F.col("size") * F.col("times")).alias("taken"))
    return taken.filter("taken > 0")
