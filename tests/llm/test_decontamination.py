import random

import pytest

from cases import letter_words, prose
from tillbook.llm import decontamination
from tillbook.llm.common import ready


def brute(docs: dict, items: dict, window=10) -> dict:
    out = {}
    for d, text in docs.items():
        words, hit, found = letter_words(text), set(), set()
        for i, item in items.items():
            own = letter_words(item)
            for at in range(max(len(own) - window, 0) + 1 if own else 0):
                w = own[at : at + window]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        found.add(str(i))
        out[d] = (len(words), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    items = {i: prose(rng.choice([3, 8, 10, 11, 30]), 500 + i) for i in range(12)}
    items |= {50: "the the the the the the the the the the the", 51: "Short ONE", 52: "", 53: None}
    docs = {}
    for d in range(60):
        parts = [prose(rng.randrange(30), 900 + d)]
        for _ in range(rng.randrange(3)):
            item = (items[rng.randrange(12)] or "").split()
            cut = rng.randrange(len(item))
            parts += [" ".join(item[cut:] if rng.random() < 0.3 else item).upper() if rng.random() < 0.3 else " -- ".join(item)]
        docs[d] = " ".join(parts)
    docs |= {97: "the " * 25, 98: "", 99: None, 100: "a short one, short one"}
    ready(spark)
    return docs, items, spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")


@pytest.mark.parametrize("options", [{}, {"part_words": 40}, {"slop": 0}])
def test_equals_brute_force(tables, options):
    docs, items, left, right = tables
    found = {r.id: r for r in decontamination.matches(left, right, **options).collect()}
    want = brute(docs, items)
    assert sum(bool(hits) for _, hits, _ in want.values()) > 15
    for d, (n, hits, own) in want.items():
        r = found[str(d)]
        assert (r.n_words, sum(r.ends) - sum(r.starts), list(r["items"])) == (n, hits, own)


def test_small_segments(tables, monkeypatch):
    docs, items, left, right = tables
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 50)
    monkeypatch.setattr(decontamination, "CANDIDATES", 3)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.report(left, right).collect()}
    assert found == {d: (n, hits, len(own)) for d, (n, hits, own) in brute(docs, items).items()}


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = item.replace("delta", "delta or so")
    far = item.replace("delta", "delta " + "x " * 9)
    docs = spark.createDataFrame([(1, item), (2, near), (3, far)], "doc_id bigint, text string")
    rows = decontamination.matches(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    found = {r.id: (list(r["items"]), list(r.near_items)) for r in rows}
    assert found == {"1": (["7"], ["7"]), "2": ([], ["7"]), "3": ([], [])}


def test_long_items_are_cut_into_pieces(spark):
    text = prose(9000, 77)
    docs = spark.createDataFrame([(1, "x " + text), (2, " ".join(text.split()[4090:4110]))], "doc_id bigint, text string")
    found = {r.doc_id: r.n_hit for r in decontamination.report(docs, spark.createDataFrame([(7, text)], "item_id bigint, text string")).collect()}
    assert found == {1: len(letter_words(text)), 2: 20}


def test_items_without_an_id_are_searched_but_not_listed(spark):
    rows = [(None, "one two three"), (None, "seven eight"), (5, "two three"), (None, None)]
    items = ready(spark).createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, "seven eight"), (3, "nine"), (4, None)], "doc_id bigint, text string")
    for options in ({}, {"part_words": 2}):
        found = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.report(docs, items, **options).collect()}
        assert found == {1: (3, 1, True), 2: (2, 0, True), 3: (0, 0, False), 4: (0, 0, False)}
    assert [r.doc_id for r in decontamination.clean(docs, items).orderBy("doc_id").collect()] == [3, 4]

