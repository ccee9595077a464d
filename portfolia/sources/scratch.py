"""Tables that are written once to the folder that driver and executors share, and read many times."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether a join of tables that are dealt by some of its keys is dealt anew by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of its own if all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="portfolia-tables-"))
    return _own[0]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(rows: DataFrame, name: str, by: str | None = None, parts: int = 1) -> DataFrame:
    """``rows`` as a table of the shared folder: plans that use it several times read it, and a lost executor costs no recomputation.

    The shuffle files of the write go with it, as nothing reads them again.
    With ``by`` the rows of one value stand in one bucket: groups that have the
    column need no shuffle, nor do joins by it alone or, in writes, by more.
    ``parts`` writes so many shares of the values of ``by`` one after the
    other, so that shuffle files of one share are there at a time; what
    ``rows`` are made of is read again for each.
    """
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, {CLEANUP: "true", ALL_KEYS: "false"}):
        if by is None:
            rows.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)
        buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), re.sub(r"\W", "_", os.path.basename(path))
        for k in range(parts):
            share = rows.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) if parts > 1 else rows
            share.repartition(buckets, by).write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).mode("append").saveAsTable(table)
        return spark.table(table)
