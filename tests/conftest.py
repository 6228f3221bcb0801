from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tillbook.schema import conform, table_schema  # noqa: E402
from tillbook.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    yield session
    session.stop()


def when(text: str) -> datetime:
    return datetime.fromisoformat(text)


def dec(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


@pytest.fixture
def table(spark):
    """Builds a retail table from dicts; absent columns are NULL."""

    def build(name: str, rows: list[dict]):
        fields = {f.name: f.dataType for f in table_schema(name).fields}
        for row in rows:
            assert set(row) <= set(fields), set(row) - set(fields)
        values = [tuple(_typed(row.get(c), kind) for c, kind in fields.items()) for row in rows]
        return conform(spark.createDataFrame(values, table_schema(name)), name)

    def _typed(value, kind):
        if value is not None and kind.typeName() == "decimal":
            return Decimal(str(value))
        if isinstance(value, str) and kind.typeName() == "timestamp":
            return when(value)
        if isinstance(value, str) and kind.typeName() == "date":
            return when(value).date()
        return value

    return build


def rows(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def only(df) -> dict:
    (row,) = rows(df)
    return row


def plan_of(df) -> str:
    """Final adaptive plan, after running the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
