"""Tables that may be related to a query table: hits of its columns, by kind, and what registered attributes link to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import distribution, profiling, sketch
from tidewater.sources.lake import Lake

HIT = ["q_column", "table_name", "column_name", "source"]


def column_hits(lake: Lake, query: str, containment: float = 0.7, score: float = 0.5, num_hash: int = sketch.NUM_HASH, num_part: int = sketch.NUM_PART) -> DataFrame:
    """(q_column, table_name, column_name, source) of the columns of other tables that answer a column of the query table:
    string columns by the containment index, tuned for each partition and size, numbers by their distributions."""
    lake.values(("string",))
    texts = lake.domains(("string",))
    banded = sketch.bands(sketch.signatures(texts, num_hash))
    others = texts.where(F.col("table_name") != query)
    placed = sketch.size_partitions(others, num_part)
    queries = texts.where(F.col("table_name") == query).groupBy(*sketch.KEY).agg(F.count(F.lit(1)).alias("n_query"))
    tuned = sketch.tune(sketch.partition_bounds(placed), queries, containment, num_hash=num_hash)
    own = F.col("table_name") == query
    strings = sketch.query_tuned(queries, banded.where(own), banded.where(~own), placed, tuned)
    numbers = lake.numbers()
    spread = distribution.ks_hits(numbers.where(own), numbers.where(~own), score)
    return strings.select("q_column", "table_name", "column_name", F.lit("containment").alias("source")).unionByName(
        spread.select(F.col("col_a").alias("q_column"), F.col("table_b").alias("table_name"), F.col("col_b").alias("column_name"), F.lit("distribution").alias("source"))
    )


def candidate_hits(lake: Lake, query: str, registry: dict[str, DataFrame] | None = None, threshold: float = 0.5, keys: int = 1, **options) -> DataFrame:
    """The hits of single columns, and the links of the ``keys`` query columns of best attribute key score."""
    found = column_hits(lake, query, **options)
    if registry is None:
        return found
    cells = lake.subset([query]).cells(("long", "string"))
    linked = profiling.search_columns(cells, lake.subset([query]).columns().select("table_name", "column_name"), registry, threshold).where(F.col("table_name") != query)
    profile = registry["attribute_values"].groupBy("attribute").agg((F.count(F.lit(1)) / F.sum("n")).alias("key_score"))
    best = linked.select("attribute").distinct().join(profile, "attribute").orderBy(F.desc("key_score"), "attribute").limit(keys)
    return found.unionByName(linked.join(best.select("attribute"), "attribute").select(F.col("col_a").alias("q_column"), "table_name", "column_name", F.lit("attribute").alias("source")))
