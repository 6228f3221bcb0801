"""What every operator does with odd tables."""

import pytest

from cases import CLASHES, DOCUMENT, messy, messy_rows, plain
from tillbook.llm import chat, decontamination, html_text, language, mixing, near_duplicates, quality, repeats, secrets, token_counts
from tillbook.llm.common import ready

ITEMS = "item_id bigint, text string"


@pytest.fixture(scope="module")
def items(ready_spark):
    texts = [messy_rows()[0][1][:200], None, "", "word", messy_rows()[0][1][:200]]
    return ready_spark.createDataFrame(list(enumerate(texts[:4])) + [(None, texts[4])], ITEMS)


@pytest.fixture(scope="module")
def ready_spark(spark):
    return ready(spark)


REPORTS = {
    "mixing": lambda docs, items: mixing.mix(docs),
    "decontamination": lambda docs, items: decontamination.report(docs, items),
    "secrets": lambda docs, items: secrets.report(docs),
    "language": lambda docs, items: language.report(docs),
    "repeats": lambda docs, items: repeats.report(docs),
    "near_duplicates": lambda docs, items: near_duplicates.report(docs),
    "token_counts": lambda docs, items: token_counts.count(docs),
    "quality": lambda docs, items: quality.report(docs),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_per_row_whatever_it_holds(ready_spark, items, name):
    found = REPORTS[name](messy(ready_spark), items)
    again = REPORTS[name](messy(ready_spark, clashes=True).repartition(5), items)
    assert found.count() == len(messy_rows())
    assert plain(found) == plain(again)


@pytest.mark.parametrize("name", REPORTS)
def test_empty_table(ready_spark, items, name):
    assert REPORTS[name](ready_spark.createDataFrame([], DOCUMENT), items).collect() == []


CLEANERS = {
    "quality": lambda docs, items: quality.clean(docs),
    "near_duplicates": lambda docs, items: near_duplicates.clean(docs),
    "decontamination": lambda docs, items: decontamination.clean(docs, items),
    "secrets": lambda docs, items: secrets.redacted(docs),
}


@pytest.mark.parametrize("name", CLEANERS)
def test_cleaners_keep_the_columns(ready_spark, items, name):
    plain_docs, wide = messy(ready_spark), messy(ready_spark, clashes=True)
    found, clashing = CLEANERS[name](plain_docs, items), CLEANERS[name](wide, items)
    assert found.dtypes == plain_docs.dtypes and clashing.dtypes == wide.dtypes
    assert plain(found) == plain(clashing.drop(*CLASHES))
    assert CLEANERS[name](plain_docs.limit(0), items).collect() == []


def test_pages(ready_spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "y"), (None, None, "", "x", "y"), (2, None, "<p>a</p>", "x", "y"), (2, None, "<p>a</p>", "x", "y"), (3, "u", "<b" * 9 + "&amp", None, None)]
    found = html_text.extract(ready_spark.createDataFrame(rows, schema))
    assert sorted((r.page_id or 0, r.text) for r in found.collect())[:4] == [(0, ""), (1, ""), (2, "a"), (2, "a")]
    assert html_text.extract(ready_spark.createDataFrame([], schema)).collect() == []


def test_conversations_without_rows(ready_spark):
    assert chat.formatted(ready_spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
