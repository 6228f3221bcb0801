"""Intermediate tables on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tillbook.session import shared_folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a join that several aggregates read: it then runs once, its readers scan
    only their own columns, and a lost executor costs a rescan, not the join.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
