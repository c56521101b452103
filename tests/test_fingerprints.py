from pyspark.sql import functions as F

from tristage.sources.provenance import other_order, table_hash


def test_rows_are_dealt_anew_in_tasks_of_bounded_size(spark):
    """A larger table gets more tasks, also where all its rows share their first column."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(0, 400_000, 1, 16).select(F.floor(F.col("id") / 1e9).alias("k"), F.xxhash64("id").alias("v"))
        dealt = other_order(df)
        rows = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("v")).collect()]
        assert len(rows) > 8 and max(rows) < 100_000 and sum(rows) == 400_000
        assert table_hash(dealt).first() == table_hash(df).first()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
