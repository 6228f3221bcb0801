"""Benchmark decontamination over a distributed positional inverted index.

The index holds, per segment of training documents, the places of every word that
the benchmark uses. Windows of benchmark words are then searched by intersecting
offset-adjusted place lists, the rarest word of the whole corpus first.
"""

from __future__ import annotations

from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import keyed, letter_words, row_id, without
from tillbook.operators.staging import staged

# Words of a segment, unless one document alone has more.
SEGMENT_WORDS = 1 << 19
# Candidates of a window search that are held at once.
CANDIDATES = 1 << 20

INDEX = "ids array<string>, fps array<bigint>, n_words array<int>, terms array<int>, counts array<int>, places array<int>"
FOUND = "id string, fp bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>, near_items array<string>"


def item_pieces(benchmark: DataFrame, window: int, piece: int) -> DataFrame:
    """``item, words``: at most ``piece`` windows of an item, which overlap by ``window - 1`` words."""

    def cut(batches):
        for batch in batches:
            items, texts, out = batch["item"].to_pylist(), batch["text"].to_pylist(), []
            for item, text in zip(items, texts):
                words = letter_words(text.encode()) if text else []
                for at in range(0, max(len(words) - window, 0) + 1 if words else 0, piece):
                    out.append({"item": item, "words": words[at : at + piece + window - 1]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary()))]))

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(cut, "item string, words array<binary>")


def windows_of(pieces: list[tuple[str | None, list[bytes]]], window: int) -> SimpleNamespace:
    """Distinct windows of some benchmark items; ``words`` are term numbers, -1 pads.

    Of the pairs ``of_window`` and ``of_item``, each says that an item has a window.
    """
    terms: dict[bytes, int] = {}
    known: dict[tuple[int, ...], int] = {}
    items: dict[str | None, int] = {}
    pairs = set()
    for item, words in pieces:
        numbers = [terms.setdefault(bytes(w), len(terms)) for w in words]
        for at in range(max(len(numbers) - window, 0) + 1):
            found = known.setdefault(tuple(numbers[at : at + window]), len(known))
            pairs.add((found, items.setdefault(item, len(items))))
    words = np.full((len(known), window), -1, np.int64)
    for row, numbers in zip(words, known):
        row[: len(numbers)] = numbers
    links = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return SimpleNamespace(
        terms=list(terms), words=words, sizes=(words >= 0).sum(axis=1), items=list(items), of_window=links[:, 0], of_item=links[:, 1]
    )


def build_index(docs: DataFrame, terms: list[bytes], gap: int) -> DataFrame:
    """One row per segment: its documents and the places of each term, in order.

    A segment numbers its words through, with ``gap`` free places after each document,
    so that no match crosses documents. Its size is bounded by SEGMENT_WORDS.
    """
    numbers = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(terms)})

    def segments(batches):
        number = numbers.value.get
        held, size = [], 0
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            for row_key, fp, text in zip(batch["id"].to_pylist(), batch["fp"].to_pylist(), texts):
                words = letter_words(text)
                found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(found >= 0)
                held.append((row_key, fp, len(words), found[at], at))
                size += len(words) + gap
                if size >= SEGMENT_WORDS:
                    yield _segment(held, gap)
                    held, size = [], 0
        if held:
            yield _segment(held, gap)

    return docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text").mapInArrow(segments, INDEX)


def _segment(held: list[tuple], gap: int) -> pa.RecordBatch:
    n_words = np.array([n for _, _, n, _, _ in held], np.int64)
    bases = np.concatenate([[0], np.cumsum(n_words + gap)[:-1]])
    terms = np.concatenate([t for _, _, _, t, _ in held])
    places = np.concatenate([at + base for (_, _, _, _, at), base in zip(held, bases)])
    order = np.argsort(terms, kind="stable")
    names, counts = np.unique(terms, return_counts=True)
    ints = lambda values: pa.array([np.asarray(values, np.int32)], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([[k for k, *_ in held]], pa.list_(pa.string())),
            pa.array([[fp for _, fp, *_ in held]], pa.list_(pa.int64())),
            ints(n_words), ints(names), ints(counts), ints(places[order]),
        ],
        names=["ids", "fps", "n_words", "terms", "counts", "places"],
    )


def search(index: DataFrame, windows: SimpleNamespace, slop: int, gap: int) -> DataFrame:
    """A row per indexed document: the spans of exact matches and the items matched.

    A window matches exactly where all its words stand in a row, and nearly where each
    word is within ``slop`` places of where it would stand counted from the rarest.
    """
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    rarity = np.zeros(max(len(windows.terms), 1), np.int64)
    for row in counts.toLocalIterator():  # one row per benchmark word, of which there are boundedly many
        rarity[row["terms"]] = row["n"]
    # Offsets of each window's words, rarest first; padding last.
    rank = np.where(windows.words >= 0, rarity[windows.words], np.iinfo(np.int64).max)
    offsets = np.argsort(rank, axis=1, kind="stable")
    ordered = np.take_along_axis(windows.words, offsets, axis=1)
    plan = index.sparkSession.sparkContext.broadcast((windows, ordered, offsets))

    def matched(batches):
        windows, ordered, offsets = plan.value
        for batch in batches:
            for segment in batch.to_pylist():
                yield _matches(segment, windows, ordered, offsets, slop, gap)

    return index.mapInArrow(matched, FOUND)


def _matches(segment: dict, windows: SimpleNamespace, ordered: np.ndarray, offsets: np.ndarray, slop: int, gap: int) -> pa.RecordBatch:
    n_words = np.array(segment["n_words"], np.int64)
    bases = np.concatenate([[0], np.cumsum(n_words + gap)[:-1]])
    terms, counts = np.array(segment["terms"], np.int64), np.array(segment["counts"], np.int64)
    places = np.array(segment["places"], np.int64)
    postings = (np.repeat(terms, counts) << 32) | places
    first = np.concatenate([[0], np.cumsum(counts)])
    here = np.full(len(windows.terms) + 1, False)  # the last entry stands for padding
    here[terms] = True
    here[-1] = True
    row_of = np.full(len(windows.terms) + 1, -1, np.int64)
    row_of[terms] = np.arange(len(terms))
    active = np.flatnonzero(here[ordered].all(axis=1))
    lists = counts[row_of[ordered[active, 0]]] if len(active) else np.zeros(0, np.int64)
    exact, near = [], []
    for part in _chunks(active, lists):
        rows = row_of[ordered[part, 0]]
        n = counts[rows]
        which = np.repeat(part, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = places[np.repeat(first[rows], n) + inner] - offsets[which, 0]
        for tolerance, found in ((0, exact), (slop, near)) if slop else ((0, exact),):
            w, s = which, start
            for r in range(1, ordered.shape[1]):
                term = ordered[w, r]
                want = (term << 32) | np.maximum(s + offsets[w, r] - tolerance, 0)
                at = np.minimum(np.searchsorted(postings, want), len(postings) - 1)
                ok = (term < 0) | ((postings[at] >= want) & (postings[at] <= ((term << 32) | np.maximum(s + offsets[w, r] + tolerance, 0))))
                w, s = w[ok], s[ok]
            found.append(np.stack([w, s]))
    w, s = np.concatenate(exact, axis=1) if exact else np.zeros((2, 0), np.int64)
    steps = np.zeros(int(bases[-1] + n_words[-1]) + gap + 1, np.int64)
    np.add.at(steps, s, 1)
    np.add.at(steps, s + windows.sizes[w], -1)
    covered = np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8), [0]])
    turns = np.diff(covered)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    span_doc = np.searchsorted(bases, starts, "right") - 1
    doc_items = _items(w, s, windows, bases)
    near_items = _items(*np.concatenate(near, axis=1), windows, bases) if near else [[] for _ in bases]
    out = {
        "id": segment["ids"], "fp": segment["fps"], "n_words": segment["n_words"],
        "starts": _grouped(starts - bases[span_doc], span_doc, len(bases)),
        "ends": _grouped(ends - bases[span_doc], span_doc, len(bases)),
        "items": doc_items, "near_items": near_items,
    }
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _chunks(windows: np.ndarray, sizes: np.ndarray):
    """Windows in order, cut where their rarest words' lists fill CANDIDATES."""
    if len(windows):
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CANDIDATES)) + 1
        yield from np.split(windows, cuts)


def _grouped(values: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(owner, np.arange(1, n)))


def _items(w: np.ndarray, s: np.ndarray, windows: SimpleNamespace, bases: np.ndarray) -> list[list[str]]:
    """Per document, the items that have one of the windows found in it."""
    out: list[list[str]] = [[] for _ in bases]
    doc = np.searchsorted(bases, s, "right") - 1
    for pair in np.unique(doc * len(windows.words) + w) if len(w) else ():
        d, found = divmod(int(pair), len(windows.words))
        lo, hi = np.searchsorted(windows.of_window, [found, found + 1])
        out[d].extend(windows.items[i] for i in windows.of_item[lo:hi] if windows.items[i] is not None)
    return [sorted(set(items)) for items in out]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, part_words: int = 2_000_000) -> DataFrame:
    """``id, fp, n_words, starts, ends, items, near_items``, one row per document row.

    ``starts`` and ``ends`` are the word spans that occurrences of windows cover,
    ``items`` the items with an exactly matched window, ``near_items`` those with a
    window matched within ``slop`` places (these included; none are sought if it is 0). A benchmark of more than ``part_words`` words
    is searched in parts of about that size, each broadcast in turn; NULL texts and
    texts without words match nothing, repeated rows give equal rows, items
    without an id are searched for like others but not listed, and without items every
    document is clean.
    """
    gap = window + 2 * slop + 1
    pieces = staged(item_pieces(benchmark, window, piece=4096), "benchmark-pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n_parts = -(-total // part_words) or 1
    part = F.pmod(F.xxhash64("item", "words"), F.lit(n_parts))
    found = None
    for number in range(n_parts):
        rows = pieces.filter(part == number).collect()  # about part_words words
        windows = windows_of([(r["item"], r["words"]) for r in rows], window)
        index = staged(build_index(docs, windows.terms, gap), "benchmark-index")
        hits = search(index, windows, slop, gap)
        found = hits if found is None else found.unionByName(hits)
    return found if n_parts == 1 else _merged(staged(found, "benchmark-hits"), docs)


def _merged(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits of several parts, joined per document key; spans may overlap between parts."""
    rich = found.filter("size(starts) > 0 or size(near_items) > 0").groupBy("id", "fp")
    rich = rich.agg(
        F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("near_items")))).alias("near_items"),
    )

    def joined(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans = []
                for span in sorted((x["starts"], x["ends"]) for x in row["spans"]):
                    if spans and span[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], span[1]))
                    else:
                        spans.append(span)
                out.append(row | {"starts": [s for s, _ in spans], "ends": [e for _, e in spans]})
            kinds = [("id", pa.string()), ("fp", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
            kinds += [("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in kinds} for r in out], pa.schema(kinds))

    rich = rich.mapInArrow(joined, "id string, fp bigint, starts array<bigint>, ends array<bigint>, items array<string>, near_items array<string>")
    lengths = build_index(docs, [], 1).select(F.explode(F.arrays_zip("ids", "fps", "n_words")).alias("d"))
    lengths = lengths.select(F.col("d.ids").alias("id"), F.col("d.fps").alias("fp"), F.col("d.n_words").cast("long").alias("n_words"))
    none = {c: F.coalesce(F.col(c), F.array().cast(k)).alias(c) for c, k in found.dtypes if k.startswith("array")}
    return lengths.join(rich, ["id", "fp"], "left").select("id", "fp", "n_words", *none.values())


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row: exact matches."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    kind = docs.schema["doc_id"].dataType
    return matches(docs, benchmark, **{"slop": 0} | options).select(
        F.when(F.col("id") != "", F.col("id").cast(kind)).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an exact match, columns as they were."""
    dirty = matches(docs, benchmark, **{"slop": 0} | options).filter(F.size("starts") > 0).select("id", "fp").distinct()
    return without(keyed(docs), staged(dirty, "contaminated")).select("row.*")
