"""Every query equals its SQL on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from conftest import DATA

FOLDER = str(DATA / "sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
RETAIL = list(contract.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect("0.001")


def test_every_query_has_sql():
    assert set(RETAIL) == set(contract.ORACLES)


@pytest.mark.parametrize("name", RETAIL)
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name], ORACLES[name], spark, duck, FOLDER) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = Path(contract.__file__).parent
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(root, tmp_path / "repo", ignore=left_out)
    check = "import __spark_entry__ as e; assert set(e.queries()) == set(e.QUERIES) and set(e.oracle_sql()) == set(e.ORACLES)"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path / "repo", check=True)
