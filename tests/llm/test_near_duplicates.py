import itertools
import random

import pytest

from cases import letter_words, messy, messy_rows, prose
from tillbook.llm import components, near_duplicates
from tillbook.llm.common import ready


def shingle_set(text):
    words = letter_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs: list[tuple]) -> list[tuple]:
    """``doc_id, class_id, links, class size`` by row."""
    sets = [shingle_set(t) for _, t in docs]
    heads, links = list(range(len(docs))), [0] * len(docs)
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) * 10 >= 8 * len(a | b):
            links[i] += 1
            links[j] += 1
            old, new = heads[j], heads[i]
            heads = [new if h == old else h for h in heads]
    out = []
    for i, (d, _) in enumerate(docs):
        members = [docs[k][0] for k in range(len(docs)) if heads[k] == heads[i]]
        known = [m for m in members if m is not None]
        out.append((d, min(known) if known else None, links[i], len(members)))
    return out


def families():
    rng = random.Random(5)
    rows = []
    for family in range(12):
        words = prose(rng.choice([6, 30, 80, 200]), family).split(" ")
        for _ in range(rng.choice([1, 2, 5, 9])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(["new", "other", "Words"])
            text = " ".join(own)
            rows.append(text.upper() if rng.random() < 0.1 else text)
    return list(enumerate(rows + ["", None, "one", "One", "one two three", "--- ,"]))


@pytest.mark.parametrize("block", [1000, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    docs = families()
    found = near_duplicates.report(spark.createDataFrame(docs, "doc_id bigint, text string"))
    want = brute(docs)
    assert sum(links > 0 for _, _, links, _ in want) > 25
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_odd_rows(spark):
    key = lambda rows: sorted(rows, key=repr)
    found = near_duplicates.report(messy(ready(spark)))
    assert key(tuple(r) for r in found.collect()) == key(brute([(d, t) for d, t, *_ in messy_rows()]))


def test_one_row_of_each_class_stays(spark):
    docs = [*families(), (500, prose(80, 3)), (500, prose(80, 3))]
    kept = near_duplicates.clean(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    want = {c for _, c, _, _ in brute(docs)}
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_prefix_is_shortened_to_the_recall():
    assert near_duplicates.prefix_length(0.8, 0.9999) == 6
    assert near_duplicates.prefix_length(0.8, 0.99) > 6 > near_duplicates.prefix_length(0.5, 0.99)


def test_recall_of_pairs_at_the_border(spark):
    """Of pairs of similarity 0.8 to 0.83, none of some hundred is missed."""
    docs = []
    for k in range(150):
        words = prose(200, 3000 + k).split()
        near = [w + "q" if i % 47 == 20 else w for i, w in enumerate(words)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    sims = [len(a & b) / len(a | b) for a, b in ((shingle_set(docs[i][1]), shingle_set(docs[i + 1][1])) for i in range(0, 300, 2))]
    want = sum(s >= 0.8 for s in sims)
    found = near_duplicates.report(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert want > 100 and found.filter("n_links > 0").count() == 2 * want


def test_components_store_few_files_and_stop_at_stars(spark, monkeypatch):
    """Edges that form stars are stored once and looked through once; however many partitions
    a shuffle has, a round stores few rows in one file."""
    kept, stored = components.staged, []

    def watched(df, label):
        out = kept(df, label)
        stored.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "staged", watched)
    rng = random.Random(6)
    stars = [(k, k % 10) for k in range(10, 300)]
    chain = [(k, k + 1) for k in range(300, 340)]
    rng.shuffle(chain)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for edges, want in ((stars, {k: k % 10 for k in range(300)}), (chain + stars, {k: k % 10 if k < 300 else 300 for k in range(341)}), ([], {})):
            stored.clear()
            found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
            assert sorted(tuple(r) for r in found) == sorted(want.items())
            assert max([0, *stored[1:]]) <= 1 and (len(stored) == 2 or edges not in (stars, []))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
