"""Patterns against plain regular expressions; the network against brute force and on spellings it has not seen."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from cases import DOCUMENT, messy, messy_rows, plain
from tillbook.llm import personal_data as pii
from tillbook.llm.common import ready

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_regex(text: str) -> list[tuple]:
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(part) <= 255 for part in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def scraps(seed: int) -> str:
    rng = random.Random(seed)
    parts = ["a.b@c.d", "@", ".", "a@b", "x@y.z-1.", "1.2.3.4", "1.2.3.", "300.1.1.1", "0001.2.3.255", "4845168114407329", "4845 1681-1440 7329", "+1 (017) 555-7713", "+", "12", " ", "-", "é", "+49 (", "+-1 ", "%", "@b.c", "5555555555554444", "..", ")"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 30)))


def test_patterns_equal_plain_regular_expressions():
    found = 0
    for seed in range(4000):
        text = scraps(seed)
        assert pii.plain_spans(text) == by_regex(text), text
        found += len(by_regex(text))
    assert found > 4000


def test_numbers_are_searched_where_digits_lie(monkeypatch):
    """Letters far from digits are not read by the patterns of numbers; what they find is the same."""
    read = []

    class Watched:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, text, start=0, end=None):
            read.append((len(text) if end is None else end) - start)
            return self.pattern.finditer(text, start, len(text) if end is None else end)

    text = "a word, \u00b2\u0661\U0001f600 " * 1000 + "from 10.0.0.1 in 2024 by 4111 1111 1111 1111 or 1.2 345-6, " + "no more. " * 1000
    want = pii.plain_spans(text)
    monkeypatch.setattr(pii, "IP", Watched(pii.IP))
    monkeypatch.setattr(pii, "CARD", Watched(pii.CARD))
    assert pii.plain_spans(text) == want and {text[s:e] for _, s, e in want} == {"10.0.0.1", "4111 1111 1111 1111"}
    assert 0 < sum(read) < 100


def test_paths_of_several_blocks_are_searched_together(monkeypatch):
    rng = np.random.default_rng(8)
    windows = rng.integers(0, pii.CLASSES, (700, pii.WINDOW)).astype(np.uint8)
    model, kept, calls = pii.fresh(4, 5), pii.best_paths, []
    model.out *= 2
    model.bias[0] = 0.9
    want = pii.decoded(windows, model)
    monkeypatch.setattr(pii, "best_paths", lambda scores, *rest: calls.append(scores.shape[2]) or kept(scores, *rest))
    monkeypatch.setattr(pii, "BLOCK", 20)
    assert (pii.decoded(windows, model) == want).all()
    assert min(calls[:-1], default=pii.HOPEFUL) >= pii.HOPEFUL and len(calls) <= 3


def test_long_runs_take_time_in_proportion():
    for text in ("x" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "1 " * 500_000):
        pii.plain_spans(text)


def small_model(seed: int) -> pii.Model:
    return pii.fresh(3, seed, np.float64)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = small_model(1)
    letters = rng.integers(0, pii.CLASSES, (5, 4))
    tags = np.array([[0, 1, 2, 2, 0], [0, 0, 3, 0, 5], [1, 1, 2, 0, 0], [0, 0, 0, 0, 0]]).T
    _, gradients = pii.loss_and_gradients(model, letters, tags)
    for part, gradient in zip(model.parts(), gradients):
        for at in rng.choice(part.size, min(part.size, 12), replace=False):
            spot = np.unravel_index(at, part.shape)
            held, losses = part[spot], []
            for step in (1e-5, -1e-5):
                part[spot] = held + step
                losses.append(pii.loss_and_gradients(model, letters, tags)[0])
            part[spot] = held
            assert gradient[spot] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(2)
    scores, moves, starts = rng.normal(size=(4, pii.TAGS, 6)), rng.normal(size=(pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS)
    found = pii.best_paths(scores, moves, starts)

    def worth(path, n):
        return starts[path[0]] + sum(scores[t, tag, n] for t, tag in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))

    for n in range(6):
        assert tuple(found[:, n]) == max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: worth(p, n))


def test_sparing_the_search_changes_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    windows = rng.integers(0, pii.CLASSES, (700, pii.WINDOW)).astype(np.uint8)
    model = pii.fresh(4, 5)
    model.out *= 2
    model.bias[0] = 0.9
    spared = pii.decoded(windows, model)
    outside = (~spared.any(axis=1)).sum()
    monkeypatch.setattr(pii, "most_gained", lambda scores, moves, starts: np.ones(scores.shape[2]))
    assert (pii.decoded(windows, model) == spared).all() and 0 < outside < 700


def test_block_states_equal_training_states():
    rng = np.random.default_rng(4)
    letters, model = rng.integers(0, pii.CLASSES, (20, 7)), pii.fresh(5, 6)
    for inputs, hidden in zip(model.inputs, model.hidden):
        states, _ = pii.run_lstm(letters, inputs, hidden)
        assert np.allclose(pii.window_states(letters, inputs, hidden).transpose(0, 2, 1), states, atol=1e-5)


def test_block_scores_equal_products_of_states_however_large_the_weights():
    rng = np.random.default_rng(5)
    letters, model = rng.integers(0, pii.CLASSES, (30, 9)), pii.fresh(5, 6)
    for scale in (1, 40, 1000):
        for inputs, hidden, out in zip(model.inputs, model.hidden, (model.out[:5], model.out[5:])):
            states, _ = pii.run_lstm(letters, inputs * scale, hidden)
            found = pii.window_states(letters, inputs * scale, hidden, out)
            assert np.isfinite(found).all() and np.allclose(found.transpose(0, 2, 1), states @ out, atol=1e-4), scale


def test_scores_of_both_ways_are_added_in_place():
    """Scores of a block are written once: a second way adds to the first one's, step by step."""
    rng = np.random.default_rng(6)
    letters, model = rng.integers(0, pii.CLASSES, (30, 9)), pii.fresh(5, 6)
    one, other = (pii.run_lstm(some, *weights)[0] for some, *weights in zip((letters, letters[::-1]), model.inputs, model.hidden))
    scores = pii.window_states(letters, model.inputs[0], model.hidden[0], model.out[:5])
    pii.window_states(letters[::-1], model.inputs[1], model.hidden[1], model.out[5:], scores[::-1])
    assert np.allclose(scores.transpose(0, 2, 1), one @ model.out[:5] + other[::-1] @ model.out[5:], atol=1e-4)
    windows = rng.integers(0, pii.CLASSES, (1024, pii.WINDOW)).astype(np.uint8)
    model.bias[0] = 9
    tracemalloc.start()
    try:
        assert not pii.decoded(windows, model).any()
        assert tracemalloc.get_traced_memory()[1] < 1.25 * 1024 * pii.WINDOW * pii.TAGS * 4
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("length", [0, 1, pii.STRIDE - 1, pii.STRIDE, pii.STRIDE + 1, 5 * pii.STRIDE + 7])
def test_windows_cover_every_letter_once(length):
    letters = np.random.default_rng(length).integers(1, pii.CLASSES, length).astype(np.uint8)
    middle = pii.windows_of(letters)[:, pii.MARGIN : pii.MARGIN + pii.STRIDE].reshape(-1)
    assert (middle[:length] == letters).all() and not middle[length:].any()


def test_spans_join_over_borders_of_windows():
    tags = np.array([0, 1, 2, 2, 2, 0, 5, 6, 5, 6, 0, 4, 4, 0], np.uint8)
    assert pii.joined(tags) == [("email", 1, 5), ("card", 6, 8), ("card", 8, 10), ("ip", 11, 13)]


EXAMPLES = {"email": "thbl.27@mail6.example.com", "ip": "129.38.82.176", "card": "4845168114407329", "phone": "+1 (017) 555-7713"}


def test_other_spellings_are_found(spark):
    """Trained on the texts' plain spans, the network finds spellings that no pattern matches."""
    docs = ready(spark).read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs)
    rng, table, hits, total = np.random.default_rng(11), pii.letter_table(), 0, 0
    for i in range(400):
        kind = pii.KINDS[i % 4]
        spelt = pii.respelled(kind, EXAMPLES[kind], rng)
        text = f"ntst in the re heat.\nIneder edly orshing {spelt} erenouble tho and of the reed"
        tags = pii.decoded(pii.windows_of(pii.classes(text, table)), model)[:, pii.MARGIN : pii.MARGIN + pii.STRIDE].reshape(-1)
        found = {(k, text[slice(*pii.trimmed(text, s, e))]) for k, s, e in pii.joined(tags[: len(text)])}
        hits += (kind, text[slice(*pii.trimmed(text, text.index(spelt), text.index(spelt) + len(spelt)))]) in found
        total += 1
    assert hits > 0.9 * total
    planted = [
        (1, "write to anna.k (at) mail4 dot example dot com or so", ["anna.k (at) mail4 dot example dot com"]),
        (2, "call (487) 555-7209 when in or at the heat", ["(487) 555-7209"]),
        (3, "from 56[.]187[.]231[.]175 in the rest", ["56[.]187[.]231[.]175"]),
        (4, "pay 4845.1681.1440.7329 on the hesth", ["4845.1681.1440.7329"]),
        (5, "x " * 20_000 + "call (487) 555-7209 now " + "y " * 20_000, ["(487) 555-7209"]),
        (6, "no more than 4845.1681.1440.7328 or 1.2.3 at the end", []),
    ]
    texts = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in planted], DOCUMENT)
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if not s.plain] for r in pii.find(texts, model).collect()}
    assert found == {i: spans for i, _, spans in planted}
    assert pii.report(docs).filter("n_network > 0").count() <= 20


def test_report_of_base_spans(spark):
    docs = ready(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = by_regex(texts[r.doc_id])
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in base)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert (r.spans == listed) == (r.n_network == 0)


def test_messy_rows_and_reruns(spark):
    docs = messy(ready(spark)).union(spark.createDataFrame([(77, "mail x.y@mail2.example.com " + "z" * 300, "en", "a", 1)], DOCUMENT))
    first, again = pii.report(docs), pii.report(docs.repartition(5))
    assert first.count() == len(messy_rows()) + 1 and plain(first) == plain(again)
    wide = messy(spark, clashes=True)
    assert plain(pii.report(wide)) == plain(pii.report(messy(spark)))


def test_nothing_to_learn_from(spark):
    docs = ready(spark).createDataFrame([(1, "no data", None, None, None), (2, None, None, None, None), (3, "", None, None, None)], DOCUMENT)
    assert pii.train(docs) is None
    assert [(r.doc_id, r.spans, r.n_email) for r in pii.report(docs).orderBy("doc_id").collect()] == [(1, "", 0), (2, "", 0), (3, "", 0)]
    assert pii.report(docs.limit(0)).collect() == []
