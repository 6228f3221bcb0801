"""Quality rules: text statistics and a robust multivariate outlier test.

For every language and source, the minimum covariance determinant estimate describes
the bulk of the documents; documents far from it are rejected. All of it is column
expressions and grouped sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import PLAIN_WORD, keyed, let, row_id, without
from tillbook.operators.staging import staged

WINDOW = 8
# Statistics are kept as multiples of 1/UNIT, so that their sums are exact and a
# verdict doesn't depend on the order in which tasks finish.
UNIT = 1024
DIMS = ["x1", "x2", "x3", "x4"]
SHARE, LIMIT = 0.75, 60.0
# Symbols per 100 words, repeated lines per 100 and words in repeated windows per 100 that
# reject a document by themselves where the bulk has none.
JUNK = {"x2": 20, "x3": 70, "x4": 28}
# Words and lines of neutral text with which a short document is filled up.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 50, 5, 10


def consistency(share: float) -> float:
    """Factor by which the covariance of the inner ``share`` of normal data, of the
    number of dimensions here, falls short of the whole."""
    half = len(DIMS) // 2
    tail = lambda x, m: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(m))
    lo, hi = 0.0, 100.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid, half) < share else (lo, mid)
    return (1 - tail(lo, half + 1)) / share


# The standard deviation that each transformed statistic has at least: every variance is
# raised by its square, so that the rates of JUNK lie at the limit.
FLOORS = {"x1": 0.05} | {x: math.log1p(rate) * math.sqrt(consistency(SHARE) / LIMIT) for x, rate in JUNK.items()}


def statistics(docs: DataFrame) -> DataFrame:
    """``id, fp, doc_id, lang, source`` and the counts of every document; NULL counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(
        F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0)),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        ),
    )
    lines = let(
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: F.struct(F.size(lines).cast("long").alias("n"), F.size(F.array_distinct(lines)).cast("long").alias("n_unlike")),
    )
    return docs.select(
        row_id(docs).alias("id"),
        F.xxhash64("text").alias("fp"),
        "doc_id",
        "lang",
        "source",
        counted.alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("l"),
    ).select(
        "id", "fp", "doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.n_unlike")).alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"),
    )


def repeated_words(words: Column) -> Column:
    """Number of words in WINDOW-word windows that occur at least twice in ``words``.

    Windows are told apart by a 64-bit hash. Documents in which all differ, nearly
    all, are done after one hash set; else the windows are sorted with their places.
    """
    n = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def places(ordered: Column) -> Column:
        twin = lambda i, x: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        again = F.filter(ordered, lambda x, i: twin(i - 1, x) | twin(i + 1, x))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        several = let(let(ordered, places), covered)
        return F.when(F.size(F.array_distinct(found)) < F.size(found), several).otherwise(F.lit(0).cast("long"))

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def transformed() -> dict[str, Column]:
    """Smoothed and logarithmic rates; short documents are drawn to the middle."""
    words, lines = F.col("n_words") + PRIOR_WORDS, F.col("n_lines") + PRIOR_LINES
    rates = {
        "x1": F.log((F.col("word_chars") + PRIOR_CHARS * PRIOR_WORDS) / words),
        "x2": F.log1p(F.col("n_symbols") * 100 / words),
        "x3": F.log1p(F.col("n_dup_lines") * 100 / lines),
        "x4": F.log1p(F.col("n_repeat_words") * 100 / words),
    }
    return {name: F.round(rate * UNIT).cast("long") for name, rate in rates.items()}


def with_cells(stats: DataFrame, least: int) -> DataFrame:
    """``cell``: language and source; those with fewer than ``least`` documents are
    pooled by language, and languages that are still small with each other."""
    for cell in (F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("")):
        if "cell" in stats.columns:
            sizes = staged(stats.filter("not base_failed").groupBy("cell").count().filter(F.col("count") < least).select("cell", F.lit(True).alias("small")), "quality-small")
            stats = stats.join(sizes, "cell", "left").withColumn("cell", F.when(F.col("small"), cell).otherwise(F.col("cell"))).drop("small")
        else:
            stats = stats.withColumn("cell", cell)
    return stats


def scored(stats: DataFrame, model: DataFrame) -> DataFrame:
    """``d2``: squared Mahalanobis distance by the cell's centre and Cholesky factor."""
    out, ys = stats.join(model, "cell", "left"), []
    for i, x in enumerate(DIMS):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
        ys.append(F.col(f"y{i}") * F.col(f"y{i}"))
    drop = [c for c in out.columns if c not in stats.columns and c != "cell"]
    return out.withColumn("d2", sum(ys[1:], ys[0])).drop(*drop)


def factored(moments: DataFrame) -> DataFrame:
    """``cell, m.., l..``: centre and Cholesky factor from ``m..`` and covariances ``c..``,
    each variance raised by the square of its statistic's floor."""
    out = moments
    for i, x in enumerate(DIMS):
        out = out.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + (FLOORS[x] * UNIT) ** 2)
    for i in range(len(DIMS)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    pairs = [f"l{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)]
    return out.select("cell", *[f"m{i}" for i in range(len(DIMS))], *pairs)


def minimum_determinant(stats: DataFrame, share: float, steps: int) -> DataFrame:
    """The model of each cell: centre and Cholesky factor of the least spread ``share`` of it.

    Starts at medians and median deviations; each step keeps the ``share`` of the
    documents nearest to the last estimate and estimates again, which never raises
    the determinant.
    """
    whole = range(len(DIMS))
    medians = staged(stats.groupBy("cell").agg(*[F.expr(f"percentile({x}, 0.5)").alias(f"m{i}") for i, x in enumerate(DIMS)]), "quality-medians")
    spread = stats.join(medians, "cell").groupBy("cell").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in whole],
        *[F.expr(f"percentile(abs({x} - m{i}), 0.5)").alias(f"s{i}") for i, x in enumerate(DIMS)],
    )
    zero = {f"c{i}{j}": F.lit(0.0) for i in whole for j in range(i)}
    model = staged(factored(spread.withColumns(zero | {f"c{i}{i}": F.pow(F.col(f"s{i}") * 1.4826, F.lit(2)) for i in whole})), "quality-model")
    for _ in range(steps):
        # A logarithmic scale of whole numbers bounds the states of the exact quantile.
        near = scored(stats, model).withColumn("step", F.floor(F.log1p("d2") * 500))
        limits = staged(near.groupBy("cell").agg(F.expr(f"percentile(step, {share})").alias("limit")), "quality-limits")
        bulk = near.join(limits, "cell").filter("step <= limit").groupBy("cell")
        sums = bulk.agg(
            F.count("*").alias("n"),
            *[F.sum(x).alias(f"t{i}") for i, x in enumerate(DIMS)],
            *[F.sum((F.col(DIMS[i]) * F.col(DIMS[j])).cast("decimal(20,0)")).alias(f"t{i}{j}") for i in whole for j in range(i + 1)],
        )
        centre = {f"m{i}": F.col(f"t{i}") / F.col("n") for i in whole}
        cov = {f"c{i}{j}": F.col(f"t{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i in whole for j in range(i + 1)}
        model = staged(factored(sums.withColumns(centre).withColumns(cov)), "quality-model")
    return model


def judged(docs: DataFrame, share: float = SHARE, steps: int = 5, least: int = 50, limit: float = LIMIT) -> DataFrame:
    """Statistics and verdict of every row: ``base_failed``, ``distance``, ``kept``.

    Rejected are documents of fewer than 20 words, those of which more than 30 % of
    the words are in repeated windows, and those whose squared robust distance exceeds
    ``limit``. NULL languages and sources are values of their own; NULL texts are empty
    and rejected; equal rows have equal verdicts; an empty table gives none.
    """
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    stats = staged(statistics(docs).withColumn("base_failed", failed).withColumns(transformed()), "quality-stats")
    stats = with_cells(stats, least)
    model = minimum_determinant(stats.filter("not base_failed"), share, steps)
    distance = F.coalesce(F.col("d2") * consistency(share), F.lit(0.0))
    return scored(stats, model).withColumn("distance", F.round(distance, 6)).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit))


def report(docs: DataFrame, **options) -> DataFrame:
    return judged(docs, **options).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def celled(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """``rows`` with language and source in ``fp``: a verdict depends on them too."""
    return rows.withColumn("fp", F.xxhash64("fp", F.to_json(F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")))))


def clean(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as they were."""
    rejected = celled(judged(docs, **options).filter("not kept"), "lang", "source")
    rejected = staged(rejected.select("id", "fp").distinct(), "quality-rejected")
    return without(celled(keyed(docs), "row.lang", "row.source"), rejected).select("row.*")
