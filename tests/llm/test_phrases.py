"""Phrases against a plain count of all of them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import DOCUMENT, messy
from tillbook.llm import phrases
from tillbook.llm.common import ready


def plain_counts(rows, longest=4) -> dict[tuple[str, str], int]:
    total = Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                total.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return total


def plain_report(rows, threshold, limit=2000):
    total = plain_counts(rows)
    found = defaultdict(list)
    candidates = {k: n for k, n in total.items() if len(k[1]) > 1 and n >= threshold}
    for (lang, words), a in candidates.items():
        holders = [n for (other, longer), n in candidates.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * n >= 80 * a for n in holders):
            continue
        cuts = [(2_000_000 * a // (total[lang, words[:k]] + total[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), total[lang, words[:k]], total[lang, words[k:]]))
    n = Counter()
    for (lang, words), count in total.items():
        n[lang] += count if len(words) == 1 else 0
    return {
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, some in found.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(some)[:limit], 1)
    }


def chatter(seed: int, docs: int = 80) -> list[tuple]:
    """Texts that repeat phrases of several lengths, so that subphrases are often held by longer ones."""
    rng = random.Random(seed)
    words = ["Ab", "c", "dé", "e\x0bf", "gh", "é", "x-y", "q\x00"]
    fixed = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(6)]
    return [(i, "".join(rng.choice(fixed + words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(40)), rng.choice(["en", "en", "de", None]), None, None) for i in range(docs)]


@pytest.mark.parametrize("shards, chunk, n_slots", [(3, 2_000_000, 1 << 24), (1, 3000, 1 << 16), (4, 300, 1 << 15), (2, 20, 2)])
def test_report_matches_brute_force(spark, shards, chunk, n_slots):
    """However many shards, however small the chunks, even if phrases share all slots."""
    rows = chatter(shards)
    docs = ready(spark).createDataFrame(rows, DOCUMENT).repartition(4)
    got = phrases.report(docs, threshold=6, shards=shards, chunk=chunk, n_slots=n_slots).collect()
    want = plain_report([(r[2], r[1]) for r in rows], 6)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_limit_and_ties(spark):
    rows = chatter(9)
    docs = ready(spark).createDataFrame(rows, DOCUMENT)
    got = phrases.report(docs, limit=7, threshold=6)
    assert {tuple(r) for r in got.collect()} == plain_report([(r[2], r[1]) for r in rows], 6, 7)


def test_phrases_that_never_reach_the_threshold_are_not_counted(spark):
    """Interleaved lengths: a phrase is counted once its parts have reached the threshold,
    in each shard once; one whose parts never do is not."""
    scan = phrases.scan
    first = np.full(1 << 16, phrases.NEVER, np.uint8)
    held = list(phrases.portions(b"one two three four. " * 10 + b"rare one", 64))
    assert [b["size"][0].as_py() for b in scan("en", held, first, 0, 3, 4)] == [0, 1]
    for word in ("one", "two", "three"):
        first[phrases.phrase_slot(word, "en", len(first))] = 1
    sizes = {p: n for b in scan("en", held, first, 1, 3, 4) for p, n, size in zip(*(b[c].to_pylist() for c in ("phrase", "n", "size"))) if size > 1}
    assert sizes == {"one two": 10, "two three": 10}
    first[phrases.phrase_slot("one two", "en", len(first))] = first[phrases.phrase_slot("two three", "en", len(first))] = 2
    later = {p: s for b in scan("en", held, first, 2, 3, 4) for p, s, size in zip(*(b[c].to_pylist() for c in ("phrase", "start", "size"))) if size > 1}
    assert later == {"one two": 1, "two three": 1, "one two three": 2}
    over = {p for b in scan("en", held, first, 4, 3, 4) for p, size in zip(b["phrase"].to_pylist(), b["size"].to_pylist())}
    assert over == {"one two three"}


def test_large_counts_stay_exact(spark):
    huge = 4_000_000_000_000_000_000
    counts = ready(spark).createDataFrame(
        [("en", "", 0, huge), ("en", "a", 1, huge), ("en", "b", 1, huge - 1), ("en", "a b", 2, huge - 2)], "lang string, phrase string, size int, n bigint"
    )
    (row,) = phrases.ranked(phrases.collocations(counts), 10).collect()
    assert (row.a, row.l, row.r, row.score) == (huge - 2, huge, huge - 1, 2_000_000 * (huge - 2) // (2 * huge - 1))


def test_messy_rows(spark):
    docs = messy(ready(spark))
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = plain_report(rows, 30)
    for table in (docs, messy(spark, clashes=True).repartition(5)):
        assert {tuple(r) for r in phrases.report(table).collect()} == want
    assert want


def test_empty_table_and_texts(spark):
    ready(spark)
    assert phrases.report(spark.createDataFrame([], DOCUMENT)).collect() == []
    assert phrases.report(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, None), (3, " .\t,", "en", None, None)], DOCUMENT)).collect() == []
