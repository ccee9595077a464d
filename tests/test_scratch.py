"""Tables that are written once: what their write leaves, and what plans over them need."""

from pyspark.sql import functions as F

from portfolia.sources.scratch import written


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}


def exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = written(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    assert not shuffle_files(spark) - before and table.count() == 97
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_dealt_tables_need_no_shuffle(spark):
    rows = spark.range(10_000).select((F.col("id") % 97).alias("k"), "id")
    for parts in (1, 3):
        dealt = written(rows, "dealt", "k", parts)
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
        assert exchanges(dealt.groupBy("k", "id").count()) == 0 and exchanges(rows.groupBy("k").count()) == 1
