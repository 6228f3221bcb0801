"""Near duplicates: an n-gram Jaccard join over MinHash bands.

Documents are sets of five-word shingles. Each of TREES bands keys documents by a
signature of its own; its length, the same for all documents, is the longest by which a
pair of the wanted similarity meets in some band with the target probability. Documents that meet,
directly or through others, are verified together, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import among, keyed, letter_words, row_id, without
from tillbook.llm.components import components
from tillbook.operators.staging import staged

WORDS = 5
TREES, DEEPEST = 32, 8
# Documents of one verification task; larger groups are cut into pairs of blocks.
BLOCK = 1000

SIGNED = "id string, fp bigint, content binary, keys array<bigint>"
VERIFIED = "content binary, other binary, links bigint"


def prefix_length(similarity: float, recall: float) -> int:
    """Length of the longest common prefix, of at most DEEPEST, by which pairs of the
    given similarity meet in one of TREES trees with probability ``recall`` or more."""
    length = DEEPEST
    while length > 1 and 1 - (1 - similarity**length) ** TREES < recall:
        length -= 1
    return length


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word, by sums of byte values times position powers."""
    text = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.arange(len(text)) - np.repeat(starts, sizes + 1)[: len(text)]
    powers = randoms(int(sizes.max()) + 1, 2) | np.uint64(1)
    values = randoms(256, 1)[text] * powers[inside]
    values[text == 32] = 0
    return mixed(np.add.reduceat(values, starts))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of all runs of WORDS words; fewer words are one shingle."""
    hashes = word_hashes(words)
    factors = randoms(WORDS, 3) | np.uint64(1)
    n = max(len(hashes) - WORDS + 1, 1)
    total = np.full(n, len(hashes) if len(hashes) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(hashes))):
        total = total + hashes[i : i + n] * factors[i]
    return np.unique(mixed(total))


def signature(found: np.ndarray, n: int) -> np.ndarray:
    """The least of ``found`` under each of ``n`` hash functions of 32 bits."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    factors = randoms(n, 4).astype(np.uint32) | np.uint32(1)
    shifts = randoms(n, 5).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        least = np.minimum(least, (low[at : at + 1024, None] * factors + shifts).min(axis=0))
    return least


def signed(docs: DataFrame, length: int) -> DataFrame:
    """Per row its key, a 128-bit hash of its words and its node in every tree's trie.

    Rows without words have neither.
    """

    def sign(batches):
        import xxhash

        factors = randoms(length, 6) | np.uint64(1)
        for batch in batches:
            contents, keys = [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = letter_words(text)
                if not words:
                    contents.append(None)
                    keys.append(None)
                    continue
                contents.append(xxhash.xxh3_128_digest(b" ".join(words)))
                least = signature(shingles(words), TREES * length).reshape(TREES, length).astype(np.uint64)
                nodes = mixed((mixed(least + np.uint64(1)) * factors).sum(axis=1) + np.arange(TREES, dtype=np.uint64))
                keys.append(nodes.astype(np.int64))
            columns = [batch["id"], batch["fp"], pa.array(contents, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "content", "keys"])

    return docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text").mapInArrow(sign, SIGNED)


def candidate_groups(texts: DataFrame) -> DataFrame:
    """``node, head``: contents that share a trie node, directly or through others.

    ``texts`` has ``node, keys``; a content's ``node`` is a hash of it, which at worst
    brings two contents more together. Trie nodes with one content are dropped; in the
    others each content is linked with the least one.
    """
    members = texts.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b != last")
    # Stored, so that a node with very many texts can be split in the join.
    shared = staged(shared.select("key", "b"), "near-shared")
    edges = members.join(shared, "key").select(F.col("node").alias("a"), "b").filter("a != b").distinct()
    return components(edges)


def verified(groups: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """``content, other, links``: per content, shares of its links (similar rows of other
    contents) and links that connect its group of similar contents.

    ``groups`` has ``content, head, id, fp, copies``. Groups of up to BLOCK contents are
    packed into lots of about that size, one task each. Larger ones are cut into blocks
    and every pair of blocks is a lot, so that no task holds more than two blocks.
    """
    sizes = groups.groupBy("head").agg(F.count("*").alias("n"))
    n_lots = -(-groups.count() // BLOCK) or 1
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    plan = groups.join(sizes, "head").withColumn("blocks", blocks)
    plan = plan.withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    partners = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(F.col("block"), i).alias("left"), F.greatest(F.col("block"), i).alias("right")),
    )
    plan = plan.withColumn("partners", partners)
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("head"), F.lit(n_lots)))
    plan = plan.select("id", "fp", "content", "head", "copies", "block", "partners", lot.alias("lot"))

    def shingle(batches):
        for batch in batches:
            found = [shingles(letter_words(t)).tobytes() for t in batch["text"].cast(pa.binary()).to_pylist()]
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(found, pa.binary())], names=columns + ["shingles"])

    texts = docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "text")
    # Rows that repeat id and text are fetched once.
    chosen = among(texts, staged(plan, "near-plan")).dropDuplicates(["id", "fp"])
    parts = chosen.select("content", "head", "copies", "block", "partners", "lot", "text").mapInArrow(
        shingle,
        "content binary, head bigint, copies bigint, block int, partners array<struct<left:int,right:int>>, lot bigint, shingles binary",
    )
    parts = parts.select("content", "head", "copies", "block", "shingles", "lot", F.explode("partners").alias("p"))
    parts = parts.select(
        F.coalesce("lot", F.xxhash64("head", "p.left", "p.right")).alias("lot"),
        "content", "head", "copies", "block", "shingles", F.col("p.left").alias("left"), F.col("p.right").alias("right"),
    )

    def verify(lot: pa.Table) -> pa.Table:
        lot = lot.sort_by([("head", "ascending"), ("left", "ascending"), ("right", "ascending"), ("content", "ascending")])
        columns = {c: lot[c].to_pylist() for c in ("head", "left", "right", "content", "block", "copies")}
        found = [np.frombuffer(s, np.uint64) for s in lot["shingles"].to_pylist()]
        at = list(zip(columns["head"], columns["left"], columns["right"]))
        cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            similar = similar_pairs(found[lo:hi], similarity)
            block = np.array(columns["block"][lo:hi])
            if columns["left"][lo] != columns["right"][lo]:
                # Pairs within a block are counted where the block meets itself.
                similar &= block[:, None] != block[None, :]
            links = similar @ np.array(columns["copies"][lo:hi], np.int64)
            for i, head in enumerate(_heads(similar)):
                out.append((columns["content"][lo + i], columns["content"][lo + head], int(links[i])))
        kinds = [("content", pa.binary()), ("other", pa.binary()), ("links", pa.int64())]
        return pa.Table.from_pylist([dict(zip(("content", "other", "links"), row)) for row in out], pa.schema(kinds))

    return parts.groupBy("lot").applyInArrow(verify, VERIFIED)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Symmetric matrix: which of the sorted sets have at least the given Jaccard similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = np.zeros((2, 2), np.float32)
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes)
        names, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # What only one set has is in no intersection.
        renumber = np.cumsum(times > 1) - 1
        keep = times[number] > 1
        owner, number = owner[keep], renumber[number[keep]]
        common = np.zeros((n, n), np.float32)
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        width = max(256, (1 << 24) // n)
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            lo, hi = np.searchsorted(number, [at, at + width])
            held = np.zeros((n, min(width, int(number[-1]) + 1 - at)), np.float32)
            held[owner[lo:hi], number[lo:hi] - at] = 1
            common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    similar = common >= similarity * union - 1e-6
    np.fill_diagonal(similar, False)
    return similar


def _heads(similar: np.ndarray) -> list[int]:
    """For each row, the first member of its connected group."""
    head = [-1] * len(similar)
    for first in range(len(similar)):
        if head[first] < 0:
            head[first], todo = first, [first]
            while todo:
                for other in np.flatnonzero(similar[todo.pop()]):
                    if head[other] < 0:
                        head[other] = first
                        todo.append(int(other))
    return head


def classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``id, fp, doc_id, head, class_id, n_links, class_size`` of every row.

    A link is another row whose shingles have at least the given Jaccard similarity,
    copies included; a class holds what links connect, ``class_id`` is the least doc_id
    in it and ``head`` a key of its own. Words are runs of digits, letters and non-ASCII characters, A-Z in lower
    case. Rows without words, or with a NULL text, have no links and form classes of
    one; rows with equal words, repeated rows too, are copies; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType
    rows = staged(signed(docs, prefix_length(similarity, recall)), "near-signed")
    number = F.when(F.col("id") != "", F.col("id").cast(kind))
    texts = rows.filter("content is not null").groupBy("content").agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "fp")).alias("at"), F.min(number).alias("least"), F.first("keys").alias("keys")
    )
    node = F.xxhash64("content").alias("node")
    texts = staged(texts.select("content", node, "copies", "at.id", "at.fp", "least", "keys"), "near-texts")
    groups = candidate_groups(texts)
    members = staged(texts.select("content", "node", "copies", "id", "fp").join(groups, "node").drop("node"), "near-members")
    found = staged(verified(members, docs, similarity), "near-verified")
    links = found.groupBy("content").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("content").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "content")
    nodes = texts.select("content", "copies", "least").join(links, "content", "left").join(joined, "content", "left")
    nodes = nodes.withColumn("head", F.coalesce("head", "content")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    nodes = staged(nodes, "near-nodes")
    whole = staged(nodes.groupBy("head").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "near-heads")
    whole = nodes.join(whole, "head").select("content", "head", F.col("links").alias("n_links"), "class_id", "class_size")
    return rows.select("id", "fp", "content", number.alias("doc_id")).join(whole, "content", "left").select(
        "id", "fp", "doc_id", "head",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def report(docs: DataFrame, **options) -> DataFrame:
    return classes(docs, **options).select("doc_id", "class_id", "n_links", "class_size")


def clean(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, columns as they were: the one with the least doc_id, of
    rows with equal ids the one with the least text hash. Rows without words all stay."""
    found = staged(classes(docs, **options).filter("class_size > 1").select("id", "fp", "doc_id", "head"), "near-classes")
    best = found.groupBy("head").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "id")).alias("best"))
    ranked = found.join(staged(best, "near-best"), "head").withColumn("stays", (F.col("id") == F.col("best.id")) & (F.col("fp") == F.col("best.fp")))
    ranked = staged(ranked.groupBy("id", "fp").agg(F.first("stays").alias("stays"), F.count("*").alias("n")), "near-ranked")
    kept = without(keyed(docs), ranked.filter("not stays").select("id", "fp"))
    repeated = ranked.filter("stays and n > 1").select("id", "fp")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = among(kept, repeated).groupBy("id", "fp").agg(F.first("row").alias("row"))
    return without(kept, repeated).select("row.*").union(once.select("row.*"))
