"""Spelling variants against a plain version over single letters."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cases import DOCUMENT, messy
from tillbook.llm import spelling
from tillbook.llm.common import ready


def plain_variants(docs: list[tuple], shortest=6, least=5) -> dict[str, tuple]:
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            total[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    words = {w: n for w, n in total.items() if len(w) >= shortest and n >= least}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and edits(w, x) == 1] for w in words}
    best = {w: min(found, key=lambda x: (-words[x], x)) for w, found in near.items() if found}
    form = {w: x for w, x in best.items() if words[x] >= 5 * words[w]}

    def root(word):
        return root(form[word]) if word in form else word

    return {w: (w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def words_of(seed: int, n: int = 250) -> list[str]:
    """Random words over few letters, many of them an edit apart, some with accents."""
    rng = random.Random(seed)
    found = ["".join(rng.choice("abü÷ze") for _ in range(rng.randint(5, 8))) for _ in range(n)]
    for _ in range(n):
        word = rng.choice(found)
        i = rng.randrange(len(word))
        found.append(rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abü") + word[i:], word[:i] + rng.choice("xyÀ") + word[i + 1 :]]))
    return found


@pytest.mark.parametrize("piece", [2048, 7])
def test_variants_match_brute_force(spark, piece):
    rng = random.Random(piece)
    words = words_of(piece)
    weights = [6 ** rng.randint(0, 3) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=160)).replace("a", "A", 7)) for i in range(120)]
    rows.append((500, " ".join(["queued"] * 5 + ["queueed"] * 30 + ["queueeed"] * 160)))
    docs = ready(spark).createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT).repartition(4)
    got = {r.word: tuple(r) for r in spelling.report(docs, piece=piece).collect()}
    want = plain_variants(rows)
    assert got == want
    assert len(want) > 100 and any(w[1] != w[2] for w in want.values() if w[1])


def test_messy_rows(spark):
    docs = messy(ready(spark))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for found in (spelling.report(docs), spelling.report(messy(spark, clashes=True).repartition(5))):
        assert {r.word: tuple(r) for r in found.collect()} == plain_variants(rows)


def test_empty_table(spark):
    assert spelling.report(ready(spark).createDataFrame([], DOCUMENT)).collect() == []


def test_long_chain_of_forms(spark):
    """Counts grow by five along a chain; every word of it ends in the last."""
    chain = [("aaaaaa" + "b" * i, 5 ** (i + 1)) for i in range(12)]
    words = ready(spark).createDataFrame(chain, "word string, n bigint")
    found = {r.word: r for r in spelling.neighbourhoods(words).collect()}
    assert all(found[w].form == "aaaaaa" + "b" * (i + 1) for i, (w, _) in enumerate(chain[:-1]))
    forms = [(w, chain[i + 1][0]) for i, (w, _) in enumerate(chain[:-1])]
    roots = spelling.rooted(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.root for r in roots} == {chain[-1][0]} and len(roots) == 11


def test_one_edit_equals_edit_distance():
    words = sorted(set(words_of(3)))
    i, j = spelling.near_pairs(words, words, rows=64)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if abs(len(x) - len(y)) <= 1 and edits(x, y) == 1}


def test_blocks_of_near_words_meet():
    """Whatever single edit, the two words' blocks are equal or one step apart."""
    steps = {tuple(s) for s in spelling.neighbours()} | {tuple(-s) for s in spelling.neighbours()} | {(0,) * spelling.CLASSES}
    words = sorted(set(words_of(5)))
    classes = spelling.classes_of(spelling.letter_counts(*spelling.codes(words)))
    for a, b in zip(*spelling.near_pairs(words, words)):
        assert tuple(classes[a] - classes[b]) in steps
    assert np.array_equal(classes.sum(axis=1), [len(w) for w in words])
