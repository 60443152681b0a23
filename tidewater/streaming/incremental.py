"""Indexing tables as they arrive: a stream of long-form cells, each batch appended to a signature index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.sketch import KEY, NUM_HASH, signatures


def index_stream(cells: DataFrame, path: str, checkpoint: str, num_hash: int = NUM_HASH):
    """Starts a query that appends the signatures of every batch of (table_name, column_name, dtype, value) to ``path``.

    Minima of batches combine by minimum, so a column that arrives in several batches is right once read by read_index.
    """

    def add(batch: DataFrame, number: int) -> None:
        signatures(batch.where("value is not null").distinct(), num_hash).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/batch=*").groupBy(*KEY, "hash_idx").agg(F.min("hv").alias("hv"))
