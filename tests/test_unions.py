"""The union of two joined tables keeps rows of one key together, whatever joins become at run time."""

from pyspark.sql import functions as F

from lumenloft.plans.scratch import sound_unions


def test_rows_of_a_key_meet(spark):
    sound_unions(spark)
    k = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 300).alias("k"), "id")
    some = k.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    a = k.join(some, "k", "left_semi").select("k", F.lit(0).alias("side"))
    b = k.filter("id < 600").join(some, "k", "left_semi").select("k", F.lit(1).alias("side"))
    tasks = a.unionByName(b).repartition("k").withColumn("task", F.spark_partition_id())
    assert tasks.groupBy("k").agg(F.countDistinct("task").alias("n")).filter("n > 1").isEmpty()
