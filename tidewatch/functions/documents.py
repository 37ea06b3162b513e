"""JSON text columns, parsed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parsed(df: DataFrame, text: Column | str, schema: str, name: str) -> DataFrame:
    """Add the parsed document as column ``name``.

    A filter on fields of a projected ``from_json`` is pushed below the projection and then
    parses the text again for every field it mentions. An exploded one-element array keeps the
    parsed value a plain column: filters stay above it and each text is parsed exactly once.
    """
    return df.withColumn(name, F.explode(F.array(F.from_json(text, schema))))
