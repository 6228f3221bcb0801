import re
from collections import Counter

import numpy as np
import pytest

from cases import messy, messy_rows, prose
from tillbook.llm import quality
from tillbook.llm.common import ready

PATH = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            again |= set(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)


def test_counts(spark):
    texts = [t for _, t, *_ in messy_rows()] + ["a b c d e f g h " * 5, "x " * 30, "one\ntwo\none\n\n \none", prose(30, 1) + "\n" + prose(30, 1), " é " * 9]
    docs = ready(spark).createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    for r in quality.report(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def plain_determinant(x: np.ndarray, share=0.75, steps=5) -> np.ndarray:
    """Squared distances by the same steps in plain numpy."""
    floors = np.array(list(quality.FLOORS.values())) * quality.UNIT
    centre = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(abs(x - centre), axis=0)) ** 2) + np.diag(floors**2)
    distance = lambda: np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    for _ in range(steps):
        step = np.floor(np.log1p(distance()) * 500)
        bulk = x[step <= np.percentile(step, 100 * share)]
        centre = bulk.mean(axis=0)
        cov = bulk.T @ bulk / len(bulk) - np.outer(centre, centre) + np.diag(floors**2)
    return distance() * quality.consistency(share)


def test_distances_equal_plain_estimate(spark):
    docs = ready(spark).read.parquet(f"{PATH}/documents.parquet")
    rows = quality.with_cells(quality.statistics(docs).selectExpr("*", "false as base_failed").withColumns(quality.transformed()), 200).collect()
    found = {r.doc_id: r for r in quality.judged(docs, least=200).collect()}
    good = [r for r in rows if not found[r.doc_id].base_failed]
    cells = {found[r.doc_id].cell for r in good}
    assert len(cells) > 1
    for cell in cells:
        own = [r for r in good if found[r.doc_id].cell == cell]
        want = plain_determinant(np.array([[r[x] for x in quality.DIMS] for r in own], float))
        assert [found[r.doc_id].distance for r in own] == pytest.approx(want, rel=1e-6, abs=1e-5)


def test_junk_goes_and_good_documents_stay(spark):
    docs = ready(spark).read.parquet(f"{PATH}/documents.parquet")
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    rows = quality.report(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert len(good) > 200 and all(r.kept for r in good)
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.4


def test_planted_outliers(spark):
    docs = [(i, prose(60 + i % 90, i), "en", "s") for i in range(200)]
    docs += [(900, "$$$ " * 50 + prose(50, 900), "en", "s"), (901, " ".join(f"{'z' * 40}{i}" for i in range(100)), "en", "s")]
    kept = {r.doc_id for r in quality.report(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).filter("kept").collect()}
    assert kept == set(range(200))


def test_each_statistic_rejects_alone(spark):
    docs = [(i, prose(60 + i % 90, i), "en", "s") for i in range(200)]
    passage = prose(300, 901).replace("\n", "")
    docs += [
        (900, " ".join(f"{w} |" for w in prose(100, 900).replace("\n", "").split()), "en", "s"),
        (901, "\n".join([w if i % 5 == 0 else "leer" for i, w in enumerate(f"{a}{b}" for a in ("ba", "de", "ki", "lo") for b in range(100))]), "en", "s"),
        (902, prose(1450, 902).replace("\n", "") + " " + passage + " " + passage, "en", "s"),
    ]
    rows = {r.doc_id: r for r in quality.report(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert {d for d, r in rows.items() if not r.kept} == {900, 901, 902}
    assert not any(r.base_failed for r in rows.values())
    assert [(r.n_symbols > 0, r.n_dup_lines > 0, r.n_repeat_words > 0) for r in (rows[900], rows[901], rows[902])] == [(True, False, False), (False, True, False), (False, False, True)]


def test_labelled_junk_goes(spark):
    docs = ready(spark).read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.report(docs).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.05
    assert all(r.kept for r in rows if r.quality == 1)


def test_verdicts_do_not_depend_on_partitions(spark):
    docs = messy(ready(spark))
    once, again = (sorted(map(repr, quality.report(d).collect())) for d in (docs, docs.repartition(7)))
    assert once == again


def test_equal_rows_of_other_cells_stay(spark):
    odd = " ".join(f"{'z' * 12}{i}" for i in range(100))
    docs = [(i, prose(60 + i % 90, i), "en", None) for i in range(100)] + [(1000 + i, " ".join(f"{'y' * 12}{i * 100 + k}" for k in range(100)), None, "en") for i in range(100)]
    docs += [(None, odd, "en", None), (None, odd, None, "en")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    assert [(r.lang, r.source) for r in quality.clean(docs).filter("doc_id is null").collect()] == [(None, "en")]


def test_consistency_factor():
    x = np.random.default_rng(0).normal(size=(200_000, 4))
    inner = x[(d := (x**2).sum(axis=1)) <= np.quantile(d, 0.75)]
    assert quality.consistency(0.75) == pytest.approx(inner.var(axis=0).mean(), rel=0.02)
