from collections import defaultdict

import pytest

from cases import messy, messy_rows
from tillbook.llm import mixing
from tillbook.llm.common import ready


def fair_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Shares by weight; what exceeds the limit is shared again until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        heavy = sum(w for s, w in weight.items() if s not in stopped) or 1
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / heavy for s in names}
        above = {s for s in names if s not in stopped and target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def checked(rows):
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    want = fair_targets(sizes)
    for source in sizes:
        assert targets[source] == pytest.approx(want[source])
        assert taken[source] <= targets[source] + 1e-6
    return sizes, targets, taken


def test_words_come_near_their_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 37 % 200), "abcdefg"[i * i % 7], None) for i in range(3000)], "doc_id int, text string, source string, lang string")
    rows = mixing.mix(docs).collect()
    _, targets, taken = checked(rows)
    for source, target in targets.items():
        assert taken[source] >= target * 0.99
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)


def test_odd_rows(spark):
    rows = mixing.mix(messy(ready(spark))).collect()
    sizes, _, _ = checked(rows)
    assert {s for _, _, _, s, _ in messy_rows()} == set(sizes)
    assert {r.taken for r in rows if r.size == 0} == {0}


def test_nested_thresholds(spark):
    places = spark.createDataFrame([("s", 10, (i * 2654435761) % (1 << 60)) for i in range(1000)], "source string, size long, place long")
    budgets = spark.createDataFrame([("s", b) for b in (0, 5, 100, 5000, 10_000, 20_000)], "source string, budget long")
    ends = {r.budget: r.below for r in mixing.thresholds(places, budgets).collect()}
    held = {b: sum(10 for i in range(1000) if (i * 2654435761) % (1 << 60) < ends[b]) for b in ends}
    assert held == {0: 0, 5: 0, 100: 100, 5000: 5000, 10_000: 10_000, 20_000: 10_000}
    assert sorted(ends.values()) == [ends[b] for b in sorted(ends)]


def test_drawn_rows_match_the_mix(spark):
    docs = messy(ready(spark), clashes=True)
    drawn = sorted((r.row.doc_id or 0, r.taken) for r in mixing.drawn(docs).collect())
    assert drawn == sorted((r.doc_id or 0, r.taken) for r in mixing.mix(docs).collect() if r.taken)


def test_repeated_rows_are_taken_as_far_as_they_fit(spark):
    rows = [(i, f"w{i} " * (1 + i * 37 % 200), "abc"[i % 3], "x") for i in range(900)]
    rows += [(None if s == "c" else 5000, "again " * 10, s, lang) for s in "abc" for i in range(2000) for lang in ("x", "y")[i % 2]]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    found = mixing.mix(docs).collect()
    _, targets, taken = checked(found)
    for source, target in targets.items():
        assert taken[source] >= target * 0.99
    assert len(found) == len(rows)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    drawn = mixing.drawn(docs).collect()
    assert sorted((r.row.doc_id or 0, r.taken) for r in drawn) == sorted((r.doc_id or 0, r.taken) for r in found if r.taken)
    again = mixing.drawn(docs.repartition(7)).collect()
    assert sorted(map(repr, drawn)) == sorted(map(repr, again))


def test_one_repeated_row(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", None)] * 50 + [(2, "a b c", "t", None)] * 50, "doc_id int, text string, source string, lang string")
    _, targets, taken = checked(mixing.mix(docs).collect())
    assert all(targets[s] - 3 < taken[s] <= targets[s] for s in targets)
