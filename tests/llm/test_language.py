import zlib

import numpy as np
import pytest

from tillbook.llm import language
from tillbook.llm.common import ready

PATH = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = ready(spark).read.parquet(PATH)
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_held_out_labels_are_never_read(spark):
    docs = ready(spark).read.parquet(PATH).limit(300)
    mask = language.held_out(docs["doc_id"])
    other = docs.selectExpr("doc_id", "text", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 'xx' else lang end as lang")
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in df.collect())
    assert docs.filter(mask).count() > 0 and key(language.report(docs)) == key(language.report(other))


def test_unknown(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 --", "en"), (4, "and the", "en"), (5, "und die", "de"), (9, "und", None)], "doc_id bigint, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score > 0) for r in language.predict(docs, language.train(docs)).collect()}
    assert found == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True), 5: ("de", True), 9: ("de", True)}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunks_count_the_same(monkeypatch, chunk):
    table = language.letters_table()
    text = "  Ünd 1 der--Hund,\n ß ab  " * 5
    whole = language.gram_counts(text, table)
    monkeypatch.setattr(language, "CHUNK", chunk)
    for a, b in zip(whole, language.gram_counts(text, table)):
        assert list(a) == list(b)


def test_l1_leaves_weights_at_zero():
    rows = [(i % 2, np.array([i % 2, 2]), np.array([0.8, 0.6])) for i in range(200)]
    dense = language.follow_the_leader(rows, 2, 0.5, 1.0, 0.0, 0.1, 1)
    sparse = language.follow_the_leader(rows, 2, 0.5, 1.0, 2.0, 0.1, 1)
    assert np.count_nonzero(sparse) < np.count_nonzero(dense)
    assert sparse[0, 0] > 0 > sparse[0, 1]


def test_temperature_fits_overconfident_scores():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(2000):
        label, said = int(rng.random() < 0.7), 1
        rows.append((label, np.array([said]), np.array([1.0])))
    weights = np.zeros((2, language.FEATURES))
    weights[1, 1] = 8.0  # says 99.97 % where 70 % is right
    chance = language.softmax(np.array([0.0, 8.0]) / language.calibrated(rows, weights))[1]
    assert chance == pytest.approx(0.7, abs=0.03)
