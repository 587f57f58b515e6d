"""Texts to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_lines(inputs: DataFrame) -> DataFrame:
    """(input, text) to (input, key, line_no, line); lines lose trailing blanks. Narrow: no shuffle."""
    lines = inputs.select("input", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("input", F.expr("cast(array() as array<bigint>)").alias("key"), F.col("line_no").cast("bigint").alias("line_no"), F.rtrim("line", F.lit("\r \t")).alias("line"))
