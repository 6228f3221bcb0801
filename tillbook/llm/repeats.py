"""Exact repeats of LENGTH bytes, by sampled suffixes in enhanced suffix arrays.

Every window of LENGTH bytes has an anchor, its GRAM-byte string of least hash, so
that equal windows have equal anchors at equal offsets, wherever they are. Suffixes
are sampled at anchors. Those with equal anchors form a bucket, whose suffix array,
common prefixes and interval tree give all repeats through that anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import row_id
from tillbook.llm.near_duplicates import mixed, randoms
from tillbook.operators.staging import staged

LENGTH, GRAM = 400, 40
# Windows that a long text is cut into at a time.
CHUNK = 1 << 19
# Sampled suffixes in one lot of buckets; a larger bucket is compared by window hashes.
LOT, HOT = 5_000, 20_000

SAMPLED = "id string, fp bigint, n_bytes bigint, sha256 string, starts array<int>, ends array<int>, anchors array<int>, grams array<bigint>, runs array<bigint>"
CONTEXT = "gram bigint, id string, fp bigint, start int, end int, anchor int, single boolean, context binary"
COVER = "id string, fp bigint, start int, end int"


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, put together by doubling."""
    factors = randoms(8, 7) | np.uint64(1)
    known = {1: randoms(256, 8)[text]}
    size = 1
    while size * 2 <= GRAM:
        part = known[size]
        known[size * 2] = part[:-size] * factors[size.bit_length()] + part[size:]
        size *= 2
    out, done = known[size], size
    for size in sorted(known, reverse=True)[1:]:
        if GRAM - done >= size:
            n = len(text) - done - size + 1
            out = out[:n] * factors[0] + known[size][done : done + n]
            done += size
    return mixed(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values, by minima from both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def sample(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, anchors, hashes`` of the runs of successive windows with one anchor.

    A run's bytes go from its first window's start to its last one's end.
    """
    values = np.frombuffer(text, np.uint8)
    width = LENGTH - GRAM + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(values) - LENGTH + 1, CHUNK):
        part = values[at : at + CHUNK + LENGTH - 1]
        hashes = gram_hashes(part)
        # Equal hashes: the leftmost wins.
        placed = (hashes & ~np.uint64(0xFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (window_minima(placed, width) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        found.append((first + at, last + at + LENGTH, anchor[first] + at, hashes[anchor[first]].astype(np.int64)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(column) for column in zip(*found))


def sampled(docs: DataFrame) -> DataFrame:
    """Per row: key, size and hash of its bytes, and its runs."""

    def sample_all(batches):
        import xxhash

        for batch in batches:
            sizes, digests, columns = [], [], ([], [], [], [], [])
            for text in batch["text"].cast(pa.binary()).to_pylist():
                text = text or b""
                starts, ends, anchors, grams = sample(text)
                sizes.append(len(text))
                digests.append(hashlib.sha256(text).hexdigest())
                runs = np.array([xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64).astype(np.int64)
                for column, values in zip(columns, (starts.astype(np.int32), ends.astype(np.int32), anchors.astype(np.int32), grams, runs)):
                    column.append(values)
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)]
            names = ["id", "fp", "n_bytes", "sha256", "starts", "ends", "anchors", "grams", "runs"]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["fp"], pa.array(sizes, pa.int64()), pa.array(digests), *arrays], names=names)

    return docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text").mapInArrow(sample_all, SAMPLED)


def contexts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of each member, from the text of its document."""
    wanted = members.groupBy("id", "fp").agg(F.collect_list(F.struct("gram", "start", "end", "anchor", "single")).alias("wanted"))
    texts = docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text")

    def cut(batches):
        for batch in batches:
            out = []
            for row_key, fp, text, wanted in zip(*(batch[c].to_pylist() for c in ("id", "fp", "text", "wanted"))):
                text = text.encode()
                out.extend(dict(w, id=row_key, fp=fp, context=text[w["start"] : w["end"]]) for w in wanted)
            kinds = [("gram", pa.int64()), ("id", pa.string()), ("fp", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
            kinds += [("anchor", pa.int32()), ("single", pa.bool_()), ("context", pa.binary())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return texts.join(wanted, ["id", "fp"]).select("id", "fp", "text", "wanted").mapInArrow(cut, CONTEXT)


def common(rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows ``a`` and ``b``, pair by pair."""
    unlike = rows[a] != rows[b]
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], np.int64)
    width = max(int(sizes.max()), 1)
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), sizes


def intervals(lcp: list[int]):
    """The common-prefix interval tree of a suffix array, bottom-up: ``depth, first, last``.

    ``lcp[i]`` belongs to the entries i and i + 1.
    """
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def bucket_repeats(lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far the longest repeats around an anchor reach to its left and right, by member.

    ``rights`` are the suffixes from the anchor on, ``lefts`` what stands before it. In
    each interval of suffixes with a common prefix, members are ordered by what stands
    before them, read backwards, and compared with their neighbours: where all agree the
    interval extends to the left as a whole, where they differ it is left-diverse and
    splits into maximal repeats. (-1, -1) where no repeat has LENGTH bytes.
    """
    n = len(rights)
    rows, sizes = matrix(rights)
    backward, left_sizes = matrix([s[::-1] for s in lefts])
    order = np.array(sorted(range(n), key=rights.__getitem__))
    by_left = np.empty(n, np.int64)
    by_left[sorted(range(n), key=lambda i: lefts[i][::-1])] = np.arange(n)
    reach = np.full((2, n), -1, np.int64)
    for depth, first, last in intervals(common(rows, sizes, order[:-1], order[1:]).tolist()):
        if depth < GRAM:
            continue
        members = order[first : last + 1]
        members = members[np.argsort(by_left[members])]
        near = common(backward, left_sizes, members[:-1], members[1:])
        left = np.maximum(np.append(near, -1), np.append(-1, near))
        enough = left + depth >= LENGTH
        found = members[enough]
        reach[0, found] = np.maximum(reach[0, found], left[enough])
        reach[1, found] = np.maximum(reach[1, found], depth)
    return reach[0], reach[1]


def bucket_covers(found: DataFrame, n_lots: int) -> DataFrame:
    """Repeats that single members share with others of their bucket."""

    def compare(lot: pa.Table) -> pa.Table:
        lot = lot.sort_by("gram")
        columns = {c: lot[c].to_pylist() for c in ("gram", "id", "fp", "start", "anchor", "single", "context")}
        grams = columns["gram"]
        cuts = [0, *(i for i in range(1, len(grams)) if grams[i] != grams[i - 1]), len(grams)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            before = [a - s for a, s in zip(columns["anchor"][lo:hi], columns["start"][lo:hi])]
            texts = columns["context"][lo:hi]
            left, right = bucket_repeats([t[:b] for t, b in zip(texts, before)], [t[b:] for t, b in zip(texts, before)])
            for i in np.flatnonzero(left >= 0).tolist():
                if columns["single"][lo + i]:
                    anchor = columns["anchor"][lo + i]
                    out.append((columns["id"][lo + i], columns["fp"][lo + i], anchor - int(left[i]), anchor + int(right[i])))
        kinds = [("id", pa.string()), ("fp", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
        return pa.Table.from_pylist([dict(zip(("id", "fp", "start", "end"), row)) for row in out], pa.schema(kinds))

    return found.withColumn("lot", F.pmod(F.xxhash64("gram"), F.lit(n_lots))).groupBy("lot").applyInArrow(lambda t: compare(t.drop(["lot"])), COVER)


def window_covers(found: DataFrame) -> DataFrame:
    """The same for buckets too large for a task: hashes of all windows, counted."""

    def windows(batches):
        import xxhash

        kinds = [("gram", pa.int64()), ("hash", pa.int64()), ("id", pa.string()), ("fp", pa.int64()), ("start", pa.int32()), ("single", pa.bool_())]
        for batch in batches:
            for row in batch.to_pylist():
                text, n = row["context"], len(row["context"]) - LENGTH + 1
                hashes = np.array([xxhash.xxh3_64_intdigest(text[i : i + LENGTH]) for i in range(n)], np.uint64).astype(np.int64)
                fixed = [pa.array([row[c]] * n, k) for c, k in (("gram", pa.int64()),)]
                rest = [pa.array([row["id"]] * n, pa.string()), pa.array([row["fp"]] * n, pa.int64())]
                starts = pa.array(np.arange(row["start"], row["start"] + n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(hashes), *rest, starts, pa.array([row["single"]] * n, pa.bool_())], names=[k for k, _ in kinds])

    hashed = staged(found.mapInArrow(windows, "gram bigint, hash bigint, id string, fp bigint, start int, single boolean"), "repeat-windows")
    twice = hashed.groupBy("gram", "hash").count().filter("count > 1").select("gram", "hash")
    return hashed.filter("single").join(twice, ["gram", "hash"]).select("id", "fp", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def covers(rows: DataFrame, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``id, fp, start, end``: byte ranges made up of repeated strings of LENGTH bytes.

    ``rows`` is the staged result of ``sampled``. A run that occurs again as a whole is
    covered at once; only the others, which lie at the ends of longer repeats, are
    compared byte by byte with the distinct runs of their bucket.
    """
    runs = rows.select("id", "fp", F.explode(F.arrays_zip("starts", "ends", "anchors", "grams", "runs")).alias("r"))
    runs = runs.select("id", "fp", F.col("r.starts").alias("start"), F.col("r.ends").alias("end"), F.col("r.anchors").alias("anchor"), F.col("r.grams").alias("gram"), F.col("r.runs").alias("run"))
    # Stored first, so that a frequent anchor's rows come straight from a shuffle into the
    # join, where adaptive execution can split them.
    several = staged(runs.groupBy("gram").count().filter("count > 1").select("gram"), "repeat-grams")
    shared = staged(runs.join(several, "gram"), "repeat-shared")
    distinct = shared.groupBy("gram", "run").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp", "start", "end", "anchor")).alias("at"))
    distinct = staged(distinct.select("gram", "run", "n", "at.*"), "repeat-runs")
    whole = shared.join(distinct.filter("n > 1").select("gram", "run"), ["gram", "run"], "left_semi").select("id", "fp", "start", "end")
    buckets = distinct.groupBy("gram").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1").select("gram", "size")
    members = distinct.join(buckets, "gram").select("gram", "size", "id", "fp", "start", "end", "anchor", (F.col("n") == 1).alias("single"))
    members = staged(members, "repeat-members")
    n = members.filter(F.col("size") <= hot).count()
    out = whole.unionByName(bucket_covers(contexts(members.filter(F.col("size") <= hot), docs), n // LOT + 1))
    if n < members.count():
        out = out.unionByName(window_covers(contexts(members.filter(F.col("size") > hot), docs)))
    return out


def cut(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``id, fp, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Removed is each byte of a text, as UTF-8, that a string of LENGTH bytes covers which
    also starts anywhere else, in any row. NULL and shorter texts lose nothing; of
    repeated rows, and of equal texts of LENGTH bytes or more, nothing is left; an empty
    table gives none.
    """
    rows = staged(sampled(docs), "repeat-samples")
    spans = covers(rows, docs, hot).groupBy("id", "fp").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text").join(staged(spans, "repeat-spans"), ["id", "fp"])

    def remove(batches):
        for batch in batches:
            removed, counts, digests = [], [], []
            for text, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist()):
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in spans):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *(x for span in merged for x in span), len(text)]
                kept = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2]):
                    kept.update(text[a:b])
                removed.append(sum(e - s for s, e in merged))
                counts.append(len(merged))
                digests.append(kept.hexdigest())
            columns = [batch["id"], batch["fp"], pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "n_removed", "n_spans", "kept_sha256"])

    less = texts.mapInArrow(remove, "id string, fp bigint, n_removed bigint, n_spans bigint, kept_sha256 string").dropDuplicates(["id", "fp"])
    joined = rows.select("id", "fp", "n_bytes", "sha256").join(staged(less, "repeat-removed"), ["id", "fp"], "left")
    return joined.select(
        "id", "fp", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def report(docs: DataFrame, **options) -> DataFrame:
    number = F.when(F.col("id") != "", F.col("id").cast(docs.schema["doc_id"].dataType)).alias("doc_id")
    return cut(docs, **options).select(number, "n_bytes", "n_removed", "n_spans", "kept_sha256")
