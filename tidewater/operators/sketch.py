"""Containment search over string columns: MinHash signatures, bands, size partitions and tuned band counts (LSH Ensemble)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default number of hashes, band width and size partitions of the index.
NUM_HASH, MAX_K, NUM_PART = 256, 4, 32
PRIME = 2**31 - 1
#: Minima that one aggregate takes at once.
GROUP = 16
KEY = ["table_name", "column_name"]


def value_hash(value: Column) -> Column:
    """28 bits of a string, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 7), 16, 10).cast("long")


def family_hash(h: Column, index: Column) -> Column:
    """The index-th member of a family of linear hashes."""
    a = (index * 2654435 + 40503) % PRIME + 1
    b = (index * 97531 + 12345) % PRIME
    return (a * h + b) % PRIME


def signatures(domains: DataFrame, num_hash: int = NUM_HASH) -> DataFrame:
    """(table_name, column_name, hash_idx, hv): minima over the distinct values of string columns, in one pass.

    The minima of all indices are one array-free aggregate with map-side combination; rows shuffled are columns x tasks.
    """
    h = domains.where("dtype = 'string'").select(*KEY, value_hash(F.col("value")).alias("h"))
    # groups of minima that whole-stage code generation can hold; all come from one scan and one exchange
    parts = F.explode(F.sequence(F.lit(0), F.lit(-(-num_hash // GROUP) - 1))).alias("g")
    index = lambda i: F.col("g").cast("long") * GROUP + i
    least = [F.min(family_hash(F.col("h"), index(i))).alias(f"m{i}") for i in range(min(GROUP, num_hash))]
    wide = h.select(*KEY, "h", parts).groupBy(*KEY, "g").agg(*least)
    long = wide.select(*KEY, "g", F.posexplode(F.array(*(f"m{i}" for i in range(min(GROUP, num_hash))))).alias("i", "hv"))
    return long.select(*KEY, (F.col("g") * GROUP + F.col("i")).cast("int").alias("hash_idx"), "hv").where(F.col("hash_idx") < num_hash)


def bands(signature: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """(table_name, column_name, band_idx, band_key): slices of max_k hashes in order."""
    return signature.groupBy(*KEY, F.floor(F.col("hash_idx") / max_k).cast("int").alias("band_idx")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hash_idx", "hv"))), lambda x: x["hv"]).alias("band_key")
    )


def not_indexed(domains: DataFrame, indexed: DataFrame) -> DataFrame:
    """Domains of tables that the index does not hold yet."""
    return domains.join(indexed.select("table_name").distinct(), "table_name", "left_anti")


def size_partitions(domains: DataFrame, num_part: int = NUM_PART, first: int = 0) -> DataFrame:
    """(table_name, column_name, n_values, part_idx): columns by size in partitions of about equal number.

    Columns are counted by size first; the running sum that orders them is over the distinct sizes, and columns of one
    size are numbered among themselves, so no task sees all columns.
    """
    from pyspark.sql import Window

    sizes = domains.where("dtype = 'string'").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_values"))
    counts = sizes.groupBy("n_values").agg(F.count(F.lit(1)).alias("c"))
    # one row for each distinct size, of which there are far fewer than columns
    before = counts.select(F.col("n_values").alias("size"), (F.sum("c").over(Window.orderBy("n_values")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))
    own = sizes.withColumn("rn", F.row_number().over(Window.partitionBy("n_values").orderBy(*KEY)))
    placed = own.join(before, F.col("n_values") == F.col("size")).withColumn("rn", F.col("rn") + F.col("before"))
    depth = F.greatest(F.ceil(F.col("total") / num_part), F.lit(1))
    return placed.select(*KEY, "n_values", (F.lit(first) + F.least(F.floor((F.col("rn") - 1) / depth), F.lit(num_part - 1))).cast("int").alias("part_idx"))


def partition_bounds(placed: DataFrame) -> DataFrame:
    return placed.groupBy("part_idx").agg(F.max("n_values").alias("upper"), F.count(F.lit(1)).alias("num_domain"))


@lru_cache(maxsize=10_000)
def optimal_kl(max_k: int, num_hash: int, upper: int, query_size: int, threshold: float, steps: int = 200) -> tuple[int, int]:
    """(k, l) of least false positive plus false negative area for a partition: containment t is Jaccard
    t / (upper / query_size + 1 - t), and a column collides with probability 1 - (1 - s**k)**l."""
    ratio = upper / max(query_size, 1)

    def collide(t: float, k: int, n: int) -> float:
        s = min(1.0, max(0.0, t / (ratio + 1 - t))) if ratio + 1 - t > 0 else 1.0
        return 1 - (1 - s**k) ** n

    best = (float("inf"), 0, 0)
    most = min(1.0, ratio)  # no column of the partition is contained to a larger share
    for k in range(1, max_k + 1):
        for n in range(1, num_hash // max_k + 1):
            cut, end = min(threshold, most), most
            false_positive = sum(collide((i + 0.5) * cut / steps, k, n) for i in range(steps)) * cut / steps
            false_negative = sum(1 - collide(cut + (i + 0.5) * (end - cut) / steps, k, n) for i in range(steps)) * (end - cut) / steps
            best = min(best, (round(false_positive + false_negative, 12), k, n))
    return best[1], best[2]


def tune(bounds: DataFrame, queries: DataFrame, threshold: float = 0.7, max_k: int = MAX_K, num_hash: int = NUM_HASH) -> DataFrame:
    """(part_idx, n_query, k, l) for each partition (part_idx, upper) and each size of a query column (n_query).

    Sizes of queries and partitions are few; each pair is tuned once on the driver.
    """
    uppers = {r["part_idx"]: r["upper"] for r in bounds.select("part_idx", "upper").collect()}
    sizes = [r["n_query"] for r in queries.select("n_query").distinct().collect()]
    rows = [(p, q, *optimal_kl(max_k, num_hash, u, q, threshold)) for p, u in sorted(uppers.items()) for q in sizes]
    return bounds.sparkSession.createDataFrame(rows, "part_idx int, n_query long, k int, l int")


def query_tuned(queries: DataFrame, query_bands: DataFrame, corpus_bands: DataFrame, placed: DataFrame, tuned: DataFrame) -> DataFrame:
    """Columns with a colliding band, k and l being those of their partition and the query column's size.

    ``queries``: (table_name, column_name, n_query); ``tuned``: (part_idx, n_query, k, l). Bands join by index and prefix.
    """
    q = query_bands.join(queries, KEY).join(tuned, "n_query").where("band_idx < l")
    q = q.select(F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"), "part_idx", "band_idx", F.lit(None).cast("int").alias("none"), "k", F.slice("band_key", F.lit(1), F.col("k")).alias("prefix")).drop("none")
    widths = tuned.select("part_idx", "k").distinct()
    c = corpus_bands.join(placed.select(*KEY, "part_idx"), KEY).join(widths, "part_idx").withColumn("prefix", F.slice("band_key", F.lit(1), F.col("k")))
    return q.join(c, ["part_idx", "band_idx", "k", "prefix"]).select("q_table", "q_column", *KEY).distinct()


def build(store, domains: DataFrame, num_hash: int = NUM_HASH, max_k: int = MAX_K, num_part: int = NUM_PART, without: list[str] | None = None) -> DataFrame:
    """Adds the tables of ``domains`` that the index in a store lacks; returns (table_name) of those added.

    New columns get size partitions after the existing ones. Tables without a string column count as indexed as well: those
    that ``domains`` has values of, or that ``without`` names, where only string columns are given.
    Signatures are written first and the list of indexed tables last, so a run that failed is done again.
    """
    fresh = not_indexed(domains, store.read("indexed"))
    named = not_indexed(domains.sparkSession.createDataFrame([(n,) for n in without or ()], "table_name string"), store.read("indexed"))
    added = [r["table_name"] for r in fresh.select("table_name").unionByName(named).distinct().collect()]
    if not added:
        return store.read("indexed").limit(0)
    text = fresh.where("dtype = 'string'")
    signed = store.add_new("signature", signatures(text, num_hash), KEY).where(F.col("table_name").isin(*added))
    known = store.read("bands").where(~F.col("table_name").isin(*added))
    first = known.agg(F.coalesce(F.max("part_idx") + 1, F.lit(0)).alias("first")).first()["first"]
    placed = size_partitions(text, num_part, first)
    own = bands(signed, max_k).join(placed.select(*KEY, "part_idx"), KEY).select("part_idx", *KEY, "band_idx", "band_key")
    kept = store.read("partitions").where(F.col("part_idx") < first)
    bounds = partition_bounds(placed).select("part_idx", "upper", "num_domain")
    store.replace("bands", known.unionByName(own))
    store.replace("partitions", kept.unionByName(bounds))
    new = domains.sparkSession.createDataFrame([(n,) for n in added], "table_name string")
    return store.add_new("indexed", new, ["table_name"]).where(F.col("table_name").isin(*added))


def query(query_bands: DataFrame, corpus_bands: DataFrame, placed: DataFrame, tuned: DataFrame) -> DataFrame:
    """Columns with a colliding band: (query columns, table_name, column_name). ``tuned``: part_idx, k, l.

    Bands join by index and key; k and l are those of the column's partition. The tuned table has a row a partition.
    """
    q = query_bands.select(F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"), "band_idx", F.col("band_key").alias("q_key"))
    c = corpus_bands.join(placed.select(*KEY, "part_idx"), KEY).join(tuned, "part_idx").where("band_idx < l").withColumn("prefix", F.slice("band_key", F.lit(1), F.col("k")))
    # the few widths in use, as an array: a query band stands once for each
    widths = F.broadcast(tuned.agg(F.collect_set("k").alias("ks")))
    q = q.join(widths, F.lit(True)).select("q_table", "q_column", "band_idx", "q_key", F.explode("ks").alias("k")).withColumn("prefix", F.slice("q_key", F.lit(1), F.col("k")))
    return q.join(c, ["band_idx", "k", "prefix"]).select("q_table", "q_column", *KEY).distinct()
