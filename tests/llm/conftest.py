import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def lower(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


LONG = "lorem ipsum dolor " * 4000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from it all day", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from it all day", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "de", "a"),
    (6, "Üben 's don't 123   x😀y  don''t\r\n\n end ", "de", "a"),
    (7, LONG, "fr", "a"),
    (None, "no id here, but words", "en", "c"),
    (9, "one two", None, "a"),
    (9, "one two", None, "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows and clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string"
    rows = spark.createDataFrame(DOCS, schema)
    extra = ["id", "fp", "part", "found", "chunk", "ids", "row", "spans", "h"]
    return rows.selectExpr("*", *(f"'x' AS `{c}`" for c in extra))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
