import random
from collections import defaultdict

import pytest

from cases import messy, messy_rows
from tillbook.llm import passages, repeats
from tillbook.llm.common import ready


def brute(texts, n=passages.WORDS):
    """Per text: at how many words a string of n words starts that another text has too."""
    split = [(t or "").encode().split() for t in texts]
    rows = defaultdict(set)
    for row, words in enumerate(split):
        for i in range(len(words) - n + 1):
            rows[tuple(words[i : i + n])].add(row)
    return [sum(len(rows[tuple(words[i : i + n])]) > 1 for i in range(len(words) - n + 1)) for words in split]


def found(docs, **options):
    return {r.doc_id: r.n_shared_passages for r in passages.report(docs, **options).collect()}


def parts():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "ça", "x"]) * rng.randrange(1, 4)
    common = [[word() for _ in range(rng.choice([20, 49, 50, 51, 52, 60, 75, 200]))] for _ in range(14)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(common)[rng.randrange(12) :] if rng.random() < 0.6 else [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t "]) for w in words))
    again = " ".join(f"s{i}" for i in range(70))
    copy = " ".join(f"c{i}" for i in range(90))
    return texts + [again + " " + again, None, "", "same " * 300, "same " * 80, " ".join(["own"] * 200), copy, copy]


@pytest.mark.parametrize("chunk", [passages.CHUNK, 30])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(passages, "CHUNK", chunk)
    texts = parts()
    want = brute(texts)
    assert sum(n > 0 for n in want) > 50 and want[-2:] == [40, 40] and want[120] == 0 and want[-3] == 0
    assert found(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")) == dict(enumerate(want))


def test_passage_of_fewer_bytes_than_a_repeat(spark):
    """A shared passage of 55 words and 329 bytes, of which the byte columns tell nothing."""
    passage = " ".join(f"pas{i:02d}" for i in range(55))
    texts = [f"one {passage} end", f"two\n{passage}", "own words " + " ".join(f"own{i}" for i in range(60))]
    assert len(passage.encode()) < repeats.LENGTH
    rows = passages.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.n_shared_passages) for r in rows} == {0: (0, 5), 1: (0, 5), 2: (0, 0)}


def test_whole_table(spark):
    docs = ready(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert found(docs) == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))


def test_repeated_rows_and_nulls(spark):
    rows = passages.report(messy(ready(spark))).collect()
    assert sorted(r.n_shared_passages for r in rows) == sorted(brute([t for _, t, *_ in messy_rows()]))
