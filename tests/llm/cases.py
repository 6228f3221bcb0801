"""Small tables with everything that real ones may hold, and plain versions of helpers."""

from __future__ import annotations

import random
import re

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns of these names must not disturb an operator.
CLASHES = ["id", "fp", "row", "size", "place", "lot", "head", "kept", "spans", "cell", "content", "label", "lines", "taken", "whole"]

VOCABULARY = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ra", "so", "tü", "vé") for b in ("n", "r", "st", "l", "mme", "ck", "x")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def messy_rows() -> list[tuple]:
    """NULLs in every column, empty and white texts, ties, repeated rows, a long text."""
    base, near = prose(120, 1), prose(120, 1).split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(near), "en", "b", None),
        (4, None, "en", "a", 0), (5, "", None, None, None), (6, " \n\t ", "de", None, 3),
        (None, prose(40, 2), "de", "b", 1), (None, prose(40, 2), "de", "b", 1), (None, None, None, None, None),
        (7, prose(60, 3), None, "c", 1), (7, prose(60, 3), None, "c", 1), (7, prose(70, 4), "fr", "c", 1),
        (8, "word", "fr", "", 4), (9, prose(30_000, 5), "en", "a", 9), (10, "x" * 50_000, "en", "a", 9),
        (11, 'token = "abcdefgh" AKIA' + "Q" * 16, "en", "b", 9), (-3, "*** ### $$$ " * 60, "de", "b", 9),
    ]
    return rows + [(100 + i, prose(50 + i, 100 + i), "en" if i % 3 else "de", "ab"[i % 2], None) for i in range(60)]


def messy(spark, clashes: bool = False):
    docs = spark.createDataFrame(messy_rows(), DOCUMENT).repartition(3)
    return docs.selectExpr("*", *[f"concat('x', doc_id) as `{c}`" for c in CLASHES]) if clashes else docs


def plain(df) -> list[str]:
    """Rows in an order of their own."""
    return sorted(repr(tuple(row)) for row in df.collect())


def letter_words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
