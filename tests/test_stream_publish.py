"""Micro-batches are parsed by all cores, whatever files they come from."""

from pyspark.sql import functions as F

from tidemark.streaming import stateful


def test_one_file_goes_to_many_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
    out = stateful.published(stream, lambda rows: rows.withColumn("task", F.spark_partition_id()), "dealt").collect()
    assert sorted(r.id for r in out) == list(range(1000))
    assert len({r.task for r in out}) >= spark.sparkContext.defaultParallelism
