"""Canonical JSON that Spark writes, against the plain writer."""

from pyspark.sql import functions as F

from portfolia.functions.text import canonical_json, canonical_object


def test_objects_equal_the_plain_writer(spark):
    texts = ["".join(map(chr, range(k, k + 16))) for k in range(0, 144, 16)] + ["\\u001F \\\x1f \\\\\x0b", "é \U0001f600/", "", None]
    rows = spark.createDataFrame([(k, t, k % 2 == 0) for k, t in enumerate(texts)], "n int, t string, flag boolean")
    inner = F.array(F.struct(F.lit("x").alias("a"), F.col("t").alias("b")))
    for r in rows.withColumn("json", canonical_object({"z": F.col("t"), "b": F.col("flag"), "a": F.col("n"), "l": inner})).collect():
        assert r.json == canonical_json({"z": r.t, "b": r.flag, "a": r.n, "l": [{"a": "x", "b": r.t}]})
