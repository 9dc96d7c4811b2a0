"""Small tables with every awkward case."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_words import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have columns of these names, too.
CLASHES = ["_id", "_key", "unit", "row", "n_words", "lang_pred", "score", "spans", "pii", "_text_", "label", "_w", "size"]


@pytest.fixture(scope="session")
def awkward_rows():
    base, long = prose(1, 300), prose(2, 20000, 9000)
    near = base.split()
    near[150] = "changed"
    passage = prose(3, 70)
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, " ".join(near), "en"),
        (3, " ".join(near), "en"),
        (None, prose(4, 120), "en"),
        (None, base, None),
        (7, None, "en"),
        (8, "", "en"),
        (9, "!!! ... ---", "en"),
        (10, "!!! ... ---", None),
        (11, "One two THREE", "en"),
        (12, "one; two, three!", "en"),
        (13, long, "en"),
        (14, long + " tail", "en"),
        (15, prose(5, 80) + "\n" + passage + "\n" + prose(6, 90), "fr"),
        (16, passage.upper() + " " + prose(7, 200), "fr"),
        (17, "the the the " * 100, "en"),
        (18, "Élan ÉLAN élan naïve 日本語 \x1c a b", None),
        (19, prose(8, 4), "de"),
        (20, "Released under the MIT License. Not the mit  license, or Apache-License general public license", "en"),
    ]
    return [(i, t, lang, f"s{n % 3}", None if t is None else len(t)) for n, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
