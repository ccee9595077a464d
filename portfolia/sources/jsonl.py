"""JSON-lines sources whose rows carry a hash, checked as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portfolia.functions.text import canonical_hash


def read_hashed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema`` from lines {"payload": {...}, "row_hash": "..."}, with ``problem`` if a line can't be trusted.

    ``unreadable`` lines are not JSON of this shape, ``hash_mismatch`` ones have
    another canonical hash than they say.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    payload = F.get_json_object("value", "$.payload")
    parts = lines.select(payload.alias("raw"), F.get_json_object("value", "$.row_hash").alias("row_hash"))
    hashed = parts.withColumn("found", F.when(F.col("raw").isNotNull(), canonical_hash(F.coalesce("raw", F.lit("null")))))
    problem = F.when(F.col("raw").isNull() | F.col("row_hash").isNull(), "unreadable").when(F.col("found") != F.col("row_hash"), "hash_mismatch")
    return hashed.select(F.from_json("raw", schema).alias("row"), "row_hash", problem.alias("problem")).select("row.*", "row_hash", "problem")


def rows_of_json(text: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per object of the JSON arrays in a column."""
    return text.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))
