"""Every stage against its brute-force version, on what its predecessor kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import DOCUMENT, messy_rows, prose
from test_decontamination import brute as brute_hits
from test_mixing import fair_targets
from test_near_duplicates import brute as brute_classes
from test_quality import counts, plain_determinant
from tillbook.llm import quality, secrets
from tillbook.llm.common import ready

TABLES = "/root/testdata/sf0.001"


def stage(spark, number, docs, folder=TABLES):
    return corpus_pipeline.STAGES[number][1](spark, docs, folder)


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """The input and what each stage made of it."""
    folder = tmp_path_factory.mktemp("stages")
    secret = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" password = hunter2222"))).otherwise(F.col("text"))
    docs = [ready(spark).read.parquet(f"{TABLES}/documents.parquet").withColumn("text", secret)]
    for number in range(5):
        stage(spark, number, docs[-1]).write.parquet(f"{folder}/{number}")
        docs.append(spark.read.parquet(f"{folder}/{number}"))
    return docs


def ids(docs):
    return sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_quality_rules(results):
    rows = {r.doc_id: r for r in results[0].collect()}
    cells = {r.doc_id: r for r in quality.judged(results[0]).collect()}
    kept = []
    for cell in {r.cell for r in cells.values()}:
        own = [d for d, r in cells.items() if r.cell == cell and not counts(rows[d].text)[-1]]
        if not own:
            continue
        far = plain_determinant(np.array([[cells[d][x] for x in quality.DIMS] for d in own], float))
        kept += [d for d, distance in zip(own, far) if distance <= 60]
    assert ids(results[1]) == sorted(kept) and 100 < len(kept) < len(rows)


def test_jaccard_join(results):
    docs = [(r.doc_id, r.text) for r in results[1].collect()]
    assert ids(results[2]) == sorted({c for _, c, _, _ in brute_classes(docs)})
    assert len(ids(results[2])) < len(docs)


def test_decontamination(spark, results):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()}
    hits = brute_hits({r.doc_id: r.text for r in results[2].collect()}, items)
    assert ids(results[3]) == sorted(d for d, (_, n, _) in hits.items() if not n)
    assert any(n for _, n, _ in hits.values())


def test_secret_scan(results):
    spans = {r.doc_id: r.spans for r in secrets.report(results[3]).collect()}
    before = {r.doc_id: r for r in results[3].collect()}
    for r in results[4].collect():
        text, out, at = before[r.doc_id].text, "", 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r.doc_id].split(",") if s):
            if start >= at:
                out, at = f"{out}{text[at:start]}[REDACTED]", end
            at = max(at, end)
        assert r.text == out + text[at:] and (not out or r.n_chars == len(r.text))
    assert ids(results[4]) == ids(results[3]) and any(spans.values())


def test_mix(results):
    """No source exceeds its target, and no document that would still fit is left out."""
    sizes = {r.doc_id: (r.source, len((r.text or "").split())) for r in results[4].collect()}
    times = {r.doc_id: r.times for r in results[5].collect()}
    assert all(r.taken == r.times * sizes[r.doc_id][1] > 0 and r.times <= 3 for r in results[5].collect())
    whole = {}
    for source, n in sizes.values():
        whole[source] = whole.get(source, 0) + n
    for source, target in fair_targets(whole).items():
        own = {d: n for d, (s, n) in sizes.items() if s == source}
        left = target - sum(times.get(d, 0) * n for d, n in own.items())
        assert left >= 0
        assert left <= 0.002 * target or all(n > left for d, n in own.items() if times.get(d, 0) <= target // whole[source])


def test_columns(results):
    assert all(docs.columns == results[0].columns for docs in results[1:5])


def test_odd_tables(spark, tmp_path):
    rows = [*messy_rows(), (600, prose(80, 1) + " password = hunter2222 " + prose(80, 9), "en", "a", 1)]
    for name, table in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        ready(spark).createDataFrame(table, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, prose(200, 77)), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert bool(found) == bool(rows if name == "some" else [])
        assert all("hunter2222" not in r.text for r in found)
