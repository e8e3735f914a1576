from pyspark.sql import functions as F

from folioframe.session import spread


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(4000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(1).write.parquet(f"{tmp_path}/one")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = spark.read.parquet(f"{tmp_path}/one")
        cores = spark.sparkContext.defaultParallelism
        assert rows.rdd.getNumPartitions() >= cores  # many partitions, all but one of them empty
        dealt = spread(rows, "id")
        held = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(held) == 4000 and len(held) >= cores and max(held) <= 2 * 4000 / cores
        even = spark.range(4000).repartition(cores)
        assert spread(even, "id") is even
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
