"""Spelling variants: words one edit apart, found by blocked Gram matrices.

Words become vectors of letter counts. One replaced letter moves such a vector by a squared
distance of two, one inserted or deleted letter by one, so a block of words is held against
another by one matrix product: ``|a|^2 + |b|^2 - 2 ab`` of all their pairs at once. Pairs at
one or two are verified letter by letter. Only blocks of equal or adjacent length meet, and
of those only blocks whose counts of letter classes allow a single edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators.staging import staged

# Maximal runs of a-z and U+00C0 to U+00FF (two bytes each in UTF-8), lower-cased before.
RUN = rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++"
# Of the doc_ids and runs whose checksum this divides, one letter is deleted.
SLIP = 199
SHORTEST, LEAST = 6, 5
# A form has at least so many times the occurrences of its variant.
RATIO = 5
# Letters: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
# Letters fall into so many classes; blocks of words have equal length and class counts.
CLASSES = 6
# Words of one block that meet in one matrix product.
PIECE = 2048
# Distinct words a task holds before it hands their counts on.
HELD = 1 << 19
# Forms have RATIO times the occurrences of their variants, and counts are below 2^63, so
# no chain has more links than 27, and each doubling follows twice as many.
DOUBLINGS = 5


def slipped(run: bytes, checksum: int) -> bytes:
    """The run without the letter that its checksum names."""
    text = run.decode()
    at = checksum % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``word, n``: occurrences of all words of at least ``shortest`` letters, after slips.

    A NULL doc_id counts as an empty one.
    """

    def counted(batches):
        find = re.compile(RUN).findall
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                runs = Counter(find((text or "").encode("utf-8", "replace").lower()))
                seed = zlib.crc32(doc_id.encode() + b":")
                for run, n in runs.items():
                    checksum = zlib.crc32(run, seed)
                    total[slipped(run, checksum) if checksum % SLIP == 0 else run] += n
                if len(total) >= HELD:
                    yield handed(total)
                    total = Counter()
        yield handed(total)

    def handed(total: Counter) -> pa.RecordBatch:
        words = [(word, n) for word, n in total.items() if len(word) >= shortest and len(word.decode()) >= shortest]
        columns = [pa.array([w for w, _ in words], pa.binary()).cast(pa.string()), pa.array([n for _, n in words], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers from 0, one after the other, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points - 97, points - 0xC0 + 26), lengths


def letter_counts(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each word."""
    spots = np.repeat(np.arange(len(lengths)) * LETTERS, lengths) + letters
    return np.bincount(spots, minlength=len(lengths) * LETTERS).reshape(-1, LETTERS).astype(np.float32)


def padded(letters: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """One row per word, filled up with -1."""
    table = np.full((len(lengths), width), -1, np.int16)
    table[np.arange(width) < lengths[:, None]] = letters
    return table


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Counts of letter classes; letters are dealt to classes in turn."""
    return np.stack([counts[:, i::CLASSES].sum(axis=1) for i in range(CLASSES)], axis=1).astype(np.int64)


def block_key(classes: np.ndarray) -> list[bytes]:
    """The block of each row of class counts; their sum is the length of the word."""
    return [row.tobytes() for row in classes.astype(np.int32)]


def neighbours() -> np.ndarray:
    """The steps by which a single edit can lead from one block to another.

    A letter moved from one class to another, or a letter more. A step and its reverse
    join the same blocks, so only one of both is listed.
    """
    one = np.eye(CLASSES, dtype=np.int64)
    moved = [one[j] - one[i] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return np.array([*moved, *one])


def one_edit(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Whether the words in equal rows differ by exactly one inserted, deleted or replaced letter."""
    swap = len_a > len_b
    a[swap], b[swap] = b[swap], a[swap]
    short, long = np.minimum(len_a, len_b), np.maximum(len_a, len_b)
    inside = np.arange(a.shape[1]) < short[:, None]
    differs = (a != b) & inside
    # From the first difference on, the rest of the shorter word must be that of the longer
    # one behind the letter it has more.
    behind = np.cumsum(differs, axis=1)[:, :-1] > 0
    shifted = (a[:, :-1] != b[:, 1:]) & inside[:, :-1] & behind
    return np.where(short == long, differs.sum(axis=1) == 1, (long == short + 1) & ~shifted.any(axis=1))


def near_pairs(home: list[str], visitors: list[str], rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart, by Gram products of the two blocks."""
    letters_a, len_a = codes(home)
    letters_b, len_b = codes(visitors)
    a, b = letter_counts(letters_a, len_a), letter_counts(letters_b, len_b)
    width = int(max(len_a.max(), len_b.max())) + 1
    table_a, table_b = padded(letters_a, len_a, width), padded(letters_b, len_b, width)
    norms = (b * b).sum(axis=1)
    found = []
    for at in range(0, len(home), rows):
        part = a[at : at + rows]
        squared = (part * part).sum(axis=1)[:, None] + norms - 2 * (part @ b.T)
        i, j = np.nonzero((squared > 0.5) & (squared < 2.5))
        i += at
        right = one_edit(table_a[i], len_a[i], table_b[j], len_b[j])
        found.append((i[right], j[right]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


WORD = "block binary, spot bigint, word string, n bigint"
PLACED = "block binary, side int, spot bigint, word string, n bigint"
SEEN = "word string, n bigint, n_near bigint, best bigint, form string"
# What a row is in a block's unit of work: a word of the block as row or as column of the
# product, or a word of another block.
HOME, OWN, GUEST = 0, 1, 2


def blocked(words: DataFrame) -> DataFrame:
    def keys(batches):
        for batch in batches:
            found = block_key(classes_of(letter_counts(*codes(batch["word"].to_pylist()))))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(batch[c] for c in ("spot", "word", "n"))], names=["block", "spot", "word", "n"])

    return words.select(F.xxhash64("word").alias("spot"), "word", "n").mapInArrow(keys, WORD)


def placed(words: DataFrame) -> DataFrame:
    """Each row at its own block, twice, and as a guest at all blocks it can be near to."""

    def visit(batches):
        steps = neighbours()
        for batch in batches:
            if not len(batch):
                continue
            own = batch["block"].to_pylist()
            classes = np.array([np.frombuffer(key, np.int32) for key in own], np.int64)
            at = [(own, np.arange(len(own)), HOME), (own, np.arange(len(own)), OWN)]
            for step in steps:
                there = classes - step
                fits = np.flatnonzero((there >= 0).all(axis=1))
                at.append((block_key(there[fits]), fits, GUEST))
            rows = pa.array(np.concatenate([rows for _, rows, _ in at]))
            keys = pa.array([key for keys, _, _ in at for key in keys], pa.binary())
            sides = pa.array([side for keys, _, side in at for _ in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([keys, sides, *(batch[c].take(rows) for c in ("spot", "word", "n"))], names=["block", "side", "spot", "word", "n"])

    return words.mapInArrow(visit, PLACED)


def neighbourhoods(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """``word, n, n_near, best, form``: near words of each word that has any, and the most
    frequent of them with its count.

    ``words`` is ``word, n``, each word once. A block's words are dealt out to pieces, and
    so are all that visit it; each pair of pieces is one unit of work, however large the
    block. A word has at most some thousand words one edit away, so nothing else grows.
    """
    words = staged(blocked(words), "letter-blocks")
    held = placed(words.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.lit(0).cast("long").alias("spot"), F.lit("").alias("word"), "n"))
    sizes = held.groupBy("block").agg(F.sum(F.when(F.col("side") == HOME, F.col("n"))).alias("own"), F.sum(F.when(F.col("side") != HOME, F.col("n"))).alias("met"))
    pieces = [F.ceil(F.col(c) / piece).cast("int").alias(name) for c, name in (("own", "rows"), ("met", "columns"))]
    sizes = staged(sizes.filter("own > 0").select("block", *pieces), "letter-block-sizes")
    at_home, spot = F.col("side") == HOME, F.shiftright("spot", 8)
    row = F.when(at_home, F.array(F.pmod(spot, "rows").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("rows") - 1))
    column = F.when(at_home, F.sequence(F.lit(0), F.col("columns") - 1)).otherwise(F.array(F.pmod(spot, "columns").cast("int")))
    units = placed(words).join(sizes, "block").withColumn("r", F.explode(row)).withColumn("c", F.explode(column)).select("block", "r", "c", "side", "word", "n")
    unit = ["block", "r", "c"]
    seen = units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compared, SEEN)
    best = F.min(F.struct((-F.col("best")).alias("best"), "form")).alias("found")
    return seen.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select(
        "word", "n", "n_near", (-F.col("found.best")).alias("best"), "found.form"
    )


def compared(batches):
    """Rows of a unit follow each other; it is compared once it is complete."""
    unit, rows, out = None, [], []
    for batch in batches:
        for *key, side, word, n in zip(*(batch[c].to_pylist() for c in ("block", "r", "c", "side", "word", "n"))):
            if key != unit:
                out += near_words(rows)
                unit, rows = key, []
            rows.append((side, word, n))
        if len(out) >= HELD >> 4:
            yield seen_batch(out)
            out = []
    yield seen_batch(out + near_words(rows))


def seen_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "n": pa.int64(), "n_near": pa.int64(), "best": pa.int64(), "form": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def near_words(rows: list[tuple[int, str, int]]) -> list[tuple]:
    """``word, n, n_near, best, form`` of a unit's words that have near ones in it.

    Words of one block meet twice, once as row and once as column of the product; of the
    two pairs that with the lesser word as row counts.
    """
    home = [(word, n) for side, word, n in rows if side == HOME]
    others = [(word, n, side) for side, word, n in rows if side != HOME]
    if not home or not others:
        return []
    near: dict[str, list] = {}
    for i, j in zip(*(found.tolist() for found in near_pairs([w for w, _ in home], [w for w, _, _ in others]))):
        (one, n), (other, m, side) = home[i], others[j]
        if side == OWN and one > other:
            continue
        for word, count, rank in ((one, n, (-m, other)), (other, m, (-n, one))):
            held = near.setdefault(word, [count, 0, rank])
            held[1] += 1
            held[2] = min(held[2], rank)
    return [(word, n, links, -rank[0], rank[1]) for word, (n, links, rank) in near.items()]


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms that starts at each word ends.

    ``forms`` is ``word, form``, each word once, words without a form left out.
    """
    chains = staged(forms.select("word", F.col("form").alias("root")), "spelling-chains")
    for _ in range(DOUBLINGS):
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if chains.join(onward, "root", "left_semi").isEmpty():
            break
        chains = staged(chains.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-chains")
    return chains


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, piece: int = PIECE) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of at least ``shortest`` letters
    with at least ``least`` occurrences.

    ``form`` is the most frequent near word, the first by code point of equal ones, if it
    has RATIO times the occurrences of the word; ``root`` is where forms lead, the word
    itself without one. NULL and empty texts have no words, repeated rows count each time,
    an empty table gives no rows.
    """
    words = staged(word_counts(docs, shortest).filter(F.col("n") >= least), "spelling-words")
    near = neighbourhoods(words, piece).select("word", "n_near", "best", F.col("form").alias("nearest"))
    found = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best") >= RATIO * F.col("n"), F.lit(False)))
    found = staged(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("is_form"), F.col("nearest")).alias("form"), F.when(F.col("is_form"), F.col("best")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = rooted(found.filter("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame, **options) -> DataFrame:
    return variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n")
