import time

from pyspark.sql import functions as F

from lodemine import session


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_shuffles_of_a_stored_frame_go_at_once(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session.CLEAN_UP, None)
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.collect_list("id").alias("ids"))
    stored = session.materialize(rows.join(spark.range(1000).withColumnRenamed("id", "k").repartition(5, "k"), "k"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(session.CLEAN_UP, None) == setting
    assert stored.count() == 1000
