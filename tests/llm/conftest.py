import random
import re

import pytest

WHITE = "[\\x20\\x09-\\x0D]"
DATA = "/root/testdata"

# Column names that the operators use themselves; inputs carry them to show that they do not clash.
CLASHING = ["size", "kept", "score", "line", "key", "pos", "rest", "fp", "copies", "row_key", "body", "bytes", "target",
            "_body_hash", "_goal_rate", "_goal_copy", "row", "key_hash", "no_id", "name", "rate", "copy", "node"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), *["x"] * len(CLASHING)) for r in rows]
        columns = ", ".join(f"{c} string" for c in ["text", "lang", "source", *CLASHING])
        return spark.createDataFrame(full, f"doc_id long, {columns}")

    return build


@pytest.fixture
def chance():
    return random.Random(7)


def strip_white(text):
    return re.sub(WHITE + "+", "", text or "")
