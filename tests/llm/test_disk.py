"""What the operators leave on disk, and how few texts they shuffle for nothing."""

import time

from pyspark.sql import functions as F

from cadencia.llm.common import by_bucket, drop_written, saved, shared_folder


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, settings = shuffle_files(spark), dict(spark.conf.getAll)
    rows = spark.range(50_000).withColumn("k", F.xxhash64("id")).repartition(5, "k").groupBy(F.pmod("k", F.lit(1001)).alias("k")).count()
    got = saved(rows, shared_folder(spark), "rows")
    assert got.count() == 1001
    for _ in range(20):
        left = {n for n in shuffle_files(spark) - before if n.endswith(".data")}
        if len(left) <= 1:  # that of the count here
            break
        time.sleep(0.5)
    assert len(left) <= 1 and dict(spark.conf.getAll) == settings
    drop_written(spark)


def test_few_rows_share_a_bucket_with_a_key(spark):
    rows = spark.range(600_000).select(F.xxhash64("id").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    keys = rows.filter("pmod(k, 3) = 0")
    some, rest = by_bucket(rows, keys, "k")
    n, others = keys.count(), rows.filter("k IS NULL OR pmod(k, 3) <> 0").count()
    assert some.columns == rest.columns == ["k"]
    assert some.filter("pmod(k, 3) = 0").count() == n and rest.filter("pmod(k, 3) = 0").count() == 0
    assert some.count() + rest.count() == n + others and some.count() - n < 0.02 * others
