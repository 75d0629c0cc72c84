"""A split table: all rows once, in a few batches that many tasks can share."""

from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postlark.streaming.runs import new_run


@pytest.mark.parametrize("parts", [1, 20])
def test_a_batch_can_be_read_by_many_tasks(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(entry, "ROW_GROUP_BYTES", 16 << 10, raising=False)
    text = F.sha2(F.col("id").cast("string"), 512)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        run = new_run(spark, "split")
        posts = entry.split_stream(spark, str(tmp_path), "documents", run)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    query = posts.writeStream.format("memory").queryName(f"split_{parts}").option("checkpointLocation", f"{run}/state")
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert len([p for p in query.recentProgress if p.numInputRows > 0]) == 5
    assert spark.table(f"split_{parts}").orderBy("doc_id").collect() == rows.orderBy("doc_id").collect()
    source = spark.read.parquet(f"{run}/source").select(F.input_file_name().alias("file"))
    files = [urlparse(row.file).path for row in source.distinct().collect()]
    assert len(files) % 5 == 0 and len(files) >= parts
    assert min(pq.ParquetFile(file).num_row_groups for file in files) > 1
