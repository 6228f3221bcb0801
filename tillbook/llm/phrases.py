"""Phrase collocations by dynamic itemset counting.

Documents are dealt out to shards, which are scanned in a cycle. Words are counted from the
first scan on. A longer phrase becomes active once both phrases that it has without its last
and without its first word have reached the threshold in the scans so far, so lengths
interleave, and it is counted in each shard exactly once: for one full cycle from where it
became active. No phrase can reach the threshold unless both its parts do, hence the counts
of all phrases that reach it are exact.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.staging import staged

UNKNOWN = "und"
LONGEST, THRESHOLD = 4, 30
# Two are the fewest that interleave lengths; more mean more and smaller jobs.
SHARDS = 2
# Bytes of text that a task counts together.
CHUNK = 12_000_000
# Slots of the table that holds, by hash of a phrase, the scan from which it extends others.
# Phrases that share a slot can activate a phrase early: it is then counted in vain, never wrong.
SLOTS = 1 << 24
NEVER = 255
PARTITIONS = 64
# Bits of the bitmap that tells phrases apart that may reach the threshold.
SPOTS = 1 << 24

# Every byte that ends a piece becomes BREAK, which UTF-8 never holds; tabs become spaces.
BREAK = b"\xff"
TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

COUNTED = "lang string, phrase string, size int, start int, n bigint"
# Rows of this size hold the number of all words of a language.
ALL_WORDS = 0


def portions(text: bytes, chunk: int) -> Iterator[bytes]:
    """The text in lower case with BREAK between pieces, cut there if longer than ``chunk``."""
    text = text.translate(TABLE)
    at = 0
    while len(text) - at > chunk:
        cut = text.rfind(BREAK, at + 1, at + chunk)
        cut = cut if cut > 0 else text.find(BREAK, at + chunk)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, int]:
    """All words as numbers in order of appearance, the words by number, and the number of BREAK."""
    joined = BREAK.join([b"", *texts, b""]).replace(BREAK, b" \xff ")
    found = pc.split_pattern(pa.array([joined], pa.large_binary()), pattern=" ").values.dictionary_encode()
    words, ids = found.dictionary, found.indices.to_numpy()
    # The text starts with a space, so the empty word is number 0 and BREAK number 1.
    return ids[ids != 0], words, 1


def word_marks(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((zlib.crc32(w, seed) for w in words), np.uint32, len(words))


def extended(marks: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those without their last word and those of the last words."""
    marks = (marks * np.uint32(0x9E3779B1)) ^ last
    marks *= np.uint32(0x85EBCA6B)
    marks ^= marks >> np.uint32(15)
    return marks


def slots(marks: np.ndarray, n_slots: int) -> np.ndarray:
    return (marks >> np.uint32(8)) & np.uint32(n_slots - 1)


def phrase_slot(phrase: str, lang: str, n_slots: int) -> int:
    marks = word_marks(phrase.encode().split(b" "), lang)
    mark = marks[:1]
    for i in range(1, len(marks)):
        mark = extended(mark, marks[i : i + 1])
    return int(slots(mark, n_slots)[0])


def scan(lang: str, texts: list[bytes], first: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, size, start, n`` of the phrases to be counted in this scan.

    ``first`` holds, per slot, the scan from which a phrase extends others. A phrase starts
    when both its parts do, and is counted in scans ``start`` to ``start + shards - 1``.
    """
    ids, words, ends = numbered(texts)
    if step < shards:
        n = np.bincount(ids, minlength=len(words))[ends + 1 :]
        yield counts_batch(lang, pa.array([b""]), ALL_WORDS, np.zeros(1), n.sum(keepdims=True))
        yield counts_batch(lang, words[ends + 1 :], 1, np.zeros(len(n)), n)
    if not step:
        return
    hashes = word_marks(words.to_pylist(), lang)
    by_word = first[slots(hashes, len(first))]
    by_word[ends] = NEVER
    since, inside = by_word[ids], ids != ends
    marks = hashes[ids]
    last = marks
    for size in range(2, longest + 1):
        # ``since`` is of the phrases of size - 1 that start at each place.
        start = np.maximum(since[:-1], since[1:])
        at = np.flatnonzero((start <= step) & (start > step - shards))
        if len(at):
            places, n = distinct(ids, at, size)
            parts = [words.take(pa.array(ids[places + i])) for i in range(size)]
            yield counts_batch(lang, pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type)), size, start[places], n)
        if size < longest:
            last, inside = last[1:], inside[:-1] & (ids[size - 1 :] != ends)
            marks = extended(marks[:-1], last)
            since = first[slots(marks, len(first))]
            since[~inside] = NEVER


def counts_batch(lang: str, phrases: pa.Array, size: int, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.repeat(lang, len(phrases)),
        phrases.cast(pa.binary()).cast(pa.string()),
        pa.array(np.full(len(phrases), size, np.int32)),
        pa.array(start.astype(np.int32)),
        pa.array(n.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "start", "n"])


def distinct(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct phrase among those at the given places, and their numbers.

    Two ids fit a key of 64 bits; for longer phrases the key so far is numbered anew.
    """
    key = ids[at].astype(np.int64)
    for i in range(1, size):
        if i > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = (key << 32) | ids[at + i]
    _, where, n = np.unique(key, return_index=True, return_counts=True)
    return at[where], n


def counted(shard: DataFrame, first, step: int, shards: int, longest: int, chunk: int) -> DataFrame:
    """Counts of one scan, as far as tasks can add them up."""

    def count(batches):
        table = np.frombuffer(zlib.decompress(first.value), np.uint8)
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        total = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                for part in portions(text, chunk):
                    held[lang].append(part)
                    total += len(part)
                    if total >= chunk:
                        for name, texts in held.items():
                            yield from scan(name, texts, table, step, shards, longest)
                        held, total = defaultdict(list), 0
        for name, texts in held.items():
            yield from scan(name, texts, table, step, shards, longest)

    return shard.mapInArrow(count, COUNTED)


def slots_of(phrases: DataFrame, n_slots: int) -> np.ndarray:
    """Slots of all these phrases: a bitmap of n_slots bits, whatever the number of
    phrases, is what reaches the driver."""

    def mark(batches):
        for batch in batches:
            found = [phrase_slot(p, lang, n_slots) for p, lang in zip(batch["phrase"].to_pylist(), batch["lang"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["slot"])

    bits = 1 << 15  # of one value of Spark's bitmap functions
    marked = phrases.select("lang", "phrase").mapInArrow(mark, "slot bigint")
    marked = marked.select(F.floor(F.col("slot") / bits).alias("part"), (F.col("slot") % bits).cast("int").alias("bit"))
    found = np.zeros(n_slots, bool)
    for row in marked.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = row["part"] * bits
        values = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")[: n_slots - at]
        found[at : at + len(values)] |= values.astype(bool)
    return found


def reached(scans: list[DataFrame], oldest: int, threshold: int) -> DataFrame:
    """``lang, phrase, size, start, n``: phrases with ``threshold`` occurrences in the given
    scans, of those that started in scan ``oldest`` or later.

    A phrase that reaches it has its share of that in some scan. Phrases with so many there
    set bits of a bitmap of SPOTS, which is broadcast: a quarter of a million numbers at
    most. Only phrases that meet a set bit are shuffled and added up; with far more
    phrases than bits all are, and results are the same.
    """
    rows = scans[0]
    for other in scans[1:]:
        rows = rows.unionByName(other)
    rows = rows.filter(F.col("start") >= oldest)
    spot = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SPOTS))
    number, bit = F.shiftright(spot, 6), (spot % 64).cast("int")
    bits = rows.filter(F.col("n") >= -(-threshold // len(scans))).select(number.alias("number"), bit.alias("bit"))
    bits = bits.groupBy("number").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    held = rows.withColumns({"number": number, "bit": bit}).join(F.broadcast(bits), "number").filter("getbit(bits, bit) = 1")
    totals = held.groupBy("lang", "phrase", "size", "start").agg(F.sum("n").alias("n"))
    return totals.filter(F.col("n") >= threshold)


def phrase_counts(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, chunk: int = CHUNK, n_slots: int = SLOTS
) -> DataFrame:
    """``lang, phrase, size, n``: all phrases of 1 to ``longest`` words with ``threshold``
    occurrences or more, and a row of size 0 per language with the number of its words.

    NULL languages are ``und``; NULL and empty texts have no words.
    """
    spark = docs.sparkSession
    rows = docs.filter("text is not null").withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(shards)))
    rows = rows.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text", "shard")
    dealt = [staged(rows.filter(F.col("shard") == i).drop("shard"), "phrase-shard") for i in range(shards)]
    first = np.full(n_slots, NEVER, np.uint8)
    scans, complete, step = [], [], 0
    # Pending are words in the first cycle and whatever a slot can still activate.
    while step < shards or ((first != NEVER) & (first > step - shards)).any():
        if step >= NEVER:
            raise ValueError("more scans than the table of slots can number")
        table = spark.sparkContext.broadcast(zlib.compress(first.tobytes(), 1))
        found = counted(dealt[step % shards], table, step, shards, longest, chunk)
        # In order of their counts, so that a look at the frequent ones skips the others' pages.
        found = found.groupBy("lang", "phrase", "size", "start").agg(F.sum("n").alias("n")).sortWithinPartitions(F.desc("n"))
        scans.append(staged(found, "phrase-scan"))
        scans, oldest = scans[-shards:], step - shards + 1
        enough = staged(reached(scans, max(oldest, 0), threshold), "phrases-reached")
        complete.append(enough.filter(F.col("start") == oldest).select("lang", "phrase", "size", "n"))
        first[slots_of(enough.filter(F.col("size").between(1, longest - 1)), n_slots) & (first == NEVER)] = step + 1
        step += 1
    done = complete[0]
    for other in complete[1:]:
        done = done.unionByName(other)
    return staged(done, "phrase-counts")


def collocations(counts: DataFrame, share: int = 80) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the candidates, phrases of two words and more,
    that no longer candidate with ``share`` percent of their occurrences holds.

    Cut in two, a phrase scores its occurrences against those of both parts, in whole
    millionths of the mean; its lowest cut counts, the first of equal ones.
    """
    words = F.split("phrase", " ", -1)
    phrases = staged(counts.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words")), "phrase-candidates")

    def joined(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    spans = phrases.filter("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    spans = spans.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    held = spans.select("lang", joined(F.col("start"), F.col("length")).alias("phrase"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = lambda column: F.col(column).cast("decimal(19,0)")
    left = phrases.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * share))
    parts = counts.filter(f"size between 1 and {LONGEST - 1}").select("lang", F.col("phrase").alias("part"), "n")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("front"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("back"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("front"), F.col("n").alias("l")), ["lang", "front"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("back"), F.col("n").alias("r")), ["lang", "back"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    totals = counts.filter(F.col("size") == ALL_WORDS).select("lang", "n")
    return best.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language with their ``rank``. Languages are cut to so many
    rows in PARTITIONS lots before they meet in one task."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    lots = Window.partitionBy("lang", "lot").orderBy(*order)
    first = found.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(PARTITIONS)))
    first = first.withColumn("place", F.row_number().over(lots)).filter(F.col("place") <= limit).drop("lot", "place")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", place).filter(F.col("rank") <= limit)


def report(docs: DataFrame, limit: int = 2000, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``limit`` phrases.

    Ties go to the more frequent phrase, then to the first by byte order. Languages
    without candidates and empty tables give no rows; repeated rows count each time.
    """
    found = ranked(collocations(phrase_counts(docs, **options)), limit)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
