"""Micro-batches of many files."""

from pyspark.sql import functions as F

from presswork.streaming import ingest


def test_a_large_batch_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(ingest, "ROWS_A_FILE", 50)
    rows = spark.range(900, numPartitions=3).withColumn("k", F.col("id") % 3)
    stream = ingest.micro_batches([rows.where(F.col("k") == k) for k in range(3)])
    got = ingest.run_to_end(stream.withColumn("file", F.input_file_name())).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.countDistinct("k").alias("ks")).collect()
    assert sorted(r[:] for r in got) == [(k, 300, 6, 1) for k in range(3)]
