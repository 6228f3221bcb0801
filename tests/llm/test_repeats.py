import hashlib
import random
from collections import Counter

import pytest

from cases import messy, messy_rows
from tillbook.llm import repeats
from tillbook.llm.common import ready


def brute(texts):
    """Per text: bytes, removed, spans and the hash of what is left."""
    n = repeats.LENGTH
    times = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        covered, done = bytearray(len(t)), 0
        for i in range(len(t) - n + 1):
            if times[t[i : i + n]] > 1:
                lo = max(i, done)
                covered[lo : i + n] = b"\1" * (i + n - lo)
                done = i + n
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(1)
    common = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([300, 399, 400, 401, 500, 900]))) for _ in range(12)]
    own = lambda: "".join(rng.choice("xyzw ") for _ in range(rng.randrange(300)))
    texts = ["".join(rng.choice(common)[rng.randrange(40) :] if rng.random() < 0.6 else own() for _ in range(rng.randrange(6))) for _ in range(120)]
    return texts + ["a" * 2000, "ab" * 400, None, "ab" * 300 + "c", "line of text\n" * 150, "", own() + "ab" * 200]


@pytest.mark.parametrize(("hot", "chunk"), [(repeats.HOT, repeats.CHUNK), (3, repeats.CHUNK), (repeats.HOT, 130)])
def test_equals_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    texts = passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: tuple(r)[1:] for r in repeats.report(docs, hot=hot).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert sum(n > 0 for _, n, _, _ in want) > 50
    assert found == dict(enumerate(want))


def test_whole_table(spark):
    docs = ready(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([(r.text or "").encode() for r in rows])))
    assert {r.doc_id: tuple(r)[1:] for r in repeats.report(docs).collect()} == want


def test_repeated_rows_and_nulls(spark):
    rows = sorted(tuple(r)[1:] for r in repeats.report(messy(ready(spark))).collect())
    assert rows == sorted(brute([(t or "").encode() for _, t, *_ in messy_rows()]))


def test_interval_tree():
    # Suffixes of "banana" in order: a, ana, anana, banana, na, nana.
    assert sorted(repeats.intervals([1, 3, 0, 0, 2])) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_reach_of_left_diverse_repeats():
    right = b"r" * 300
    lefts = [b"x" + b"l" * 200, b"y" + b"l" * 200, b"z" + b"l" * 50, b"l" * 120]
    left, reach = repeats.bucket_repeats(lefts, [right + b"1", right + b"2", right + b"3", right + b"4"])
    assert list(left) == [200, 200, -1, 120] and list(reach) == [300, 300, -1, 300]
