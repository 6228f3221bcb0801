"""Passages of WORDS words that a text shares with another row, whatever bytes they take.

As in ``repeats``, a window's anchor is its string of least hash, here of GRAM words, so that
equal windows have equal anchors. A run is what successive windows with one anchor cover. Runs
that occur in several rows are shared as a whole; only where one row's run differs from
those of other rows with its anchor are hashes of the windows compared, one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm import repeats
from tillbook.llm.common import among, row_id
from tillbook.llm.near_duplicates import mixed, randoms, word_hashes
from tillbook.operators.staging import staged

WORDS, GRAM = 51, 12
# Windows that a long text is cut into at a time.
CHUNK = 1 << 19

RUNS = "id string, fp bigint, grams array<bigint>, runs array<bigint>, sizes array<int>"
WINDOWS = "id string, fp bigint, gram bigint, several boolean, hash bigint, times int"


def string_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` values from each position, put together by doubling."""
    factors = randoms(16, 11) | np.uint64(1)
    out, done, part, width = None, 0, values, 1
    while True:
        if size & width:
            n = len(values) - done - width + 1
            out = part[:n] if out is None else out[:n] * factors[width.bit_length()] + part[done : done + n]
            done += width
        if done == size:
            return mixed(out)
        part = part[:-width] * factors[8 + width.bit_length()] + part[width:]
        width *= 2


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hashes`` of all windows, and ``first, last, grams, runs`` of the runs of successive
    windows with one anchor: window numbers and hashes of the anchor and of the run's words."""
    words = text.split()
    none = np.zeros(0, np.int64)
    if len(words) < WORDS:
        return none.astype(np.uint64), none, none, none, none
    values = word_hashes(words)
    hashes = string_hashes(values, WORDS)
    found = []
    for at in range(0, len(hashes), CHUNK):
        grams = string_hashes(values[at : at + CHUNK + WORDS - 1], GRAM)
        # Equal hashes: the leftmost wins.
        placed = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (repeats.window_minima(placed, WORDS - GRAM + 1) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        found.append((first + at, last + at, grams[anchor[first]]))
    first, last, grams = (np.concatenate(column) for column in zip(*found))
    # A run is no longer than two windows, so that its first and last one hold all its words.
    factors = randoms(3, 12) | np.uint64(1)
    runs = mixed(hashes[first] * factors[0] + hashes[last] * factors[1] + (last - first).astype(np.uint64) * factors[2])
    return hashes, first, last, grams.astype(np.int64), runs.astype(np.int64)


def runs_of(docs: DataFrame) -> DataFrame:
    """Per row: key, and the anchors, hashes and numbers of windows of its runs."""

    def find(batches):
        for batch in batches:
            columns = ([], [], [])
            for text in batch["text"].cast(pa.binary()).to_pylist():
                _, first, last, grams, runs = windows_of(text or b"")
                for column, values in zip(columns, (grams, runs, (last - first + 1).astype(np.int32))):
                    column.append(values)
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["fp"], *arrays], names=["id", "fp", "grams", "runs", "sizes"])

    return docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text").mapInArrow(find, RUNS)


def member_windows(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct windows of each member, from the text of its row, and how often they start there."""
    wanted = members.groupBy("id", "fp").agg(F.collect_list(F.struct("gram", "run", "several")).alias("wanted"))
    texts = docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text")

    def cut(batches):
        kinds = [("id", pa.string()), ("fp", pa.int64()), ("gram", pa.int64()), ("several", pa.bool_()), ("hash", pa.int64()), ("times", pa.int32())]
        for batch in batches:
            out = []
            for key, fp, text, wanted in zip(*(batch[c].to_pylist() for c in ("id", "fp", "text", "wanted"))):
                hashes, first, last, grams, runs = windows_of(text.encode())
                several = {(w["gram"], w["run"]): w["several"] for w in wanted}
                at: dict[tuple[int, bool], list[np.ndarray]] = {}
                for lo, hi, gram, run in zip(first.tolist(), last.tolist(), grams.tolist(), runs.tolist()):
                    if (gram, run) in several:
                        at.setdefault((gram, several[gram, run]), []).append(hashes[lo : hi + 1])
                for (gram, held), parts in at.items():
                    values, times = np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
                    out.append((key, fp, gram, held, values, times))
            if not out:
                continue
            keys, fps, grams, held, values, times = zip(*out)
            of = pa.array(np.repeat(np.arange(len(out)), [len(v) for v in values]))
            fixed = [pa.array(c, k).take(of) for c, (_, k) in zip((keys, fps, grams, held), kinds)]
            counted = [pa.array(np.concatenate(values), pa.int64()), pa.array(np.concatenate(times).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *counted], names=[name for name, _ in kinds])

    return among(texts, staged(wanted, "passage-wanted")).select("id", "fp", "text", "wanted").mapInArrow(cut, WINDOWS)


def shared_windows(docs: DataFrame) -> DataFrame:
    """``id, fp, n_shared_passages`` of each row that shares any: at how many of its words a string
    of WORDS words starts that also occurs in another row. Equal rows share all they have."""
    found = staged(runs_of(docs), "passage-runs")
    rows = found.select("id", "fp", F.explode(F.arrays_zip("grams", "runs", "sizes")).alias("r"))
    rows = rows.select("id", "fp", F.col("r.grams").alias("gram"), F.col("r.runs").alias("run"), F.col("r.sizes").alias("size"))
    # Stored first, as in repeats, so that adaptive execution can split a frequent anchor.
    often = staged(rows.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "passage-grams")
    shared = staged(rows.join(often, "gram"), "passage-shared")
    # Rows are told apart by their keys; those with equal keys are found by their number.
    twice = staged(found.groupBy("id", "fp").agg(F.count("*").alias("rows")).filter("rows > 1").select("id", "fp"), "passage-copies")
    row = F.struct("id", "fp")
    distinct = shared.groupBy("gram", "run").agg(F.min(row).alias("at"), F.max(row).alias("other"))
    distinct = distinct.select("gram", "run", "at.*", (F.col("at") != F.col("other")).alias("several"))
    distinct = staged(distinct, "passage-distinct")
    whole = shared.join(distinct.filter("several").select("gram", "run"), ["gram", "run"], "left_semi").select("id", "fp", F.col("size").cast("long").alias("n"))
    unlike = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.bool_and("several").alias("all_several"), F.bool_or("several").alias("any_several"), F.min(row).alias("at"), F.max(row).alias("other"))
    unlike = unlike.filter("kinds > 1 and not all_several and (any_several or at <> other)").select("gram")
    members = staged(distinct.join(unlike, "gram").select("gram", "run", "id", "fp", "several"), "passage-members")
    windows = staged(member_windows(members, docs), "passage-windows")
    both = windows.groupBy("gram", "hash").agg(F.min(row).alias("at"), F.max(row).alias("other"), F.bool_or("several").alias("held"))
    both = both.filter("held or at <> other").select("gram", "hash")
    part = windows.filter("not several").join(both, ["gram", "hash"], "left_semi").select("id", "fp", F.col("times").cast("long").alias("n"))
    total = whole.unionByName(part).groupBy("id", "fp").agg(F.sum("n").alias("n"))
    every = found.join(twice, ["id", "fp"], "left_semi").select("id", "fp", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("all")).dropDuplicates(["id", "fp"])
    return total.join(every, ["id", "fp"], "full_outer").select("id", "fp", F.coalesce("all", "n").alias("n_shared_passages"))


def report(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``repeats.report``, and ``n_shared_passages``, which takes in passages of WORDS
    words that are shorter than ``repeats.LENGTH`` bytes."""
    number = F.when(F.col("id") != "", F.col("id").cast(docs.schema["doc_id"].dataType)).alias("doc_id")
    found = repeats.cut(docs, **options).join(staged(shared_windows(docs), "passage-counts"), ["id", "fp"], "left")
    return found.select(number, "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_shared_passages", F.lit(0)).alias("n_shared_passages"))
