"""Set similarities of columns and tables. Values are deduplicated first, so a pair join has one row per shared value
and pair of columns, never one per pair of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.sources.lake import Lake

KEY = ["table_name", "column_name", "pos", "dtype"]


def _side(domains: DataFrame, side: str) -> DataFrame:
    return domains.select(F.col("table_name").alias(f"table_{side}"), F.col("column_name").alias(f"col_{side}"), F.col("pos").alias(f"pos_{side}"), "dtype", *[c for c in domains.columns if c not in KEY])


def _size(domains: DataFrame) -> Column:
    """How many values rows of a domain frame stand for: one each, or ``size`` where the frame holds a lake's classes."""
    return F.sum("size") if "size" in domains.columns else F.count(F.lit(1))


def pair_counts(a: DataFrame, b: DataFrame, same_type: bool = True) -> DataFrame:
    """Sizes and shared values of column pairs with a common value, from domains of two tables or lakes, or from the classes of
    one lake, by which the join has a row for each class and pair of columns."""
    if ("size" in a.columns) != ("size" in b.columns) or (not same_type and "size" in a.columns):
        raise ValueError("classes are of one lake and type")
    sizes = [_side(d.groupBy(*KEY).agg(_size(d).alias(f"n_{s}")), s) for d, s in ((a, "a"), (b, "b"))]
    on = ["dtype", "value"] if same_type else ["value"]
    right = _side(b.drop("size"), "b")
    shared = _side(a, "a").join(right if same_type else right.drop("dtype"), on).groupBy("table_a", "col_a", "pos_a", "table_b", "col_b", "pos_b", "dtype").agg(_size(a).alias("both"))
    out = shared.join(sizes[0], ["table_a", "col_a", "pos_a", "dtype"])
    return out.join(sizes[1] if same_type else sizes[1].drop("dtype"), ["table_b", "col_b", "pos_b", *(["dtype"] if same_type else [])])


def jaccard(both: Column, n_a: Column, n_b: Column) -> Column:
    """0 where either side is empty."""
    return F.when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(both / (n_a + n_b - both))


def similar_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column pairs with jaccard and containment (of a in b)."""
    p = pair_counts(a, b)
    return p.withColumn("jaccard", jaccard(F.col("both"), F.col("n_a"), F.col("n_b"))).withColumn("containment", F.col("both") / F.col("n_a"))


def column_jaccard(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """One row: shared, n_a, n_b, jaccard of two columns, 0 if either has no value."""
    x, y = a.select(F.col(col_a).alias("v")).where("v is not null").distinct(), b.select(F.col(col_b).alias("v")).where("v is not null").distinct()
    marked = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "v", "full")
    counts = marked.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.coalesce(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("shared"))
    return counts.withColumn("jaccard", jaccard(F.col("shared"), F.col("n_a"), F.col("n_b")))


def key_row_similarity(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: the largest Jaccard of the values of a pair of key columns, 0 without keys."""
    out = None
    for x, y in pairs:
        one = column_jaccard(a, x, b, y).select("jaccard")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return a.sparkSession.createDataFrame([(0.0,)], "jaccard double")
    return out.agg(F.max("jaccard").alias("jaccard"))


def record_similarity(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean over keys of a in b of the mean Jaccard of the cell sets of matching rows."""
    cells = lambda df: F.array_distinct(F.array(*(F.coalesce(df[c].cast("string"), F.lit("nan")) for c in columns)))
    x, y = a.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), cells(a).alias("x")), b.select(F.col(key).alias("k"), cells(b).alias("y"))
    each = x.join(y, "k").select("row", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("s"))
    return each.groupBy("row").agg(F.avg("s").alias("s")).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("record_similarity"))


def column_similarity(n_a: int, n_b: int, mapped: int, key_factor: float = 1.0) -> float:
    """Share of columns that a mapping covers."""
    below = n_b + n_a - mapped
    return (1 + (mapped - 1) * key_factor) / below if mapped and below else 0.0


def new_column_rate(n_a: int, mapped: int) -> float:
    return (n_a - mapped) / n_a if n_a else 0.0


def new_row_rate(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Largest over key pairs of 1 - shared distinct values / rows of a."""
    rows = a.agg(F.count(F.lit(1)).alias("rows"))
    out = None
    for x, y in pairs:
        shared = a.select(F.col(x).alias("v")).distinct().join(b.select(F.col(y).alias("v")), "v", "left_semi").agg(F.count(F.lit(1)).alias("shared"))
        one = shared.crossJoin(rows).select((1 - F.try_divide("shared", "rows")).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.max("rate").alias("new_row_rate"))


def values_once(df: DataFrame, column: str) -> DataFrame:
    """(k): the values that stand exactly once in a column."""
    return df.groupBy(F.col(f"`{column}`").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n = 1 and k is not null").select("k")


def null_fills(a: DataFrame, b: DataFrame, key: tuple[str, str], pairs: list[tuple[str, str]], once: bool = False) -> DataFrame:
    """Cells null or NaN in a that b fills, over rows matched by key, and their share of all cells of a.

    ``once``: only over rows whose key stands once in each table, as a detected key pairs them.
    """
    kinds = dict([(f"a{i}", a.schema[p].dataType) for i, (p, _) in enumerate(pairs)] + [(f"b{i}", b.schema[p].dataType) for i, (_, p) in enumerate(pairs)])
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c].typeName() in ("double", "float") else F.col(c).isNull()
    x = a.select(F.col(key[0]).alias("k"), *(F.col(p).alias(f"a{i}") for i, (p, _) in enumerate(pairs)))
    y = b.select(F.col(key[1]).alias("k"), *(F.col(p).alias(f"b{i}") for i, (_, p) in enumerate(pairs)))
    if once:
        x, y = x.join(values_once(a, key[0]), "k"), y.join(values_once(b, key[1]), "k")
    fills = sum((F.when(gone(f"a{i}") & ~gone(f"b{i}"), 1).otherwise(0) for i in range(len(pairs))), F.lit(0))
    size = a.agg((F.count(F.lit(1)) * len(a.columns)).alias("cells"))
    return x.join(y, "k").agg(F.coalesce(F.sum(fills), F.lit(0)).alias("fills")).crossJoin(size).select("fills", F.coalesce(F.try_divide("fills", "cells"), F.lit(0.0)).alias("nan_delta"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that equal tables share, whatever the order of their rows."""
    row = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null")) for c in df.columns), F.lit(str(df.dtypes)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("total"), F.bit_xor(row).alias("parity"))


def without_copies(lake: Lake, ranked: list[str], k: int) -> list[str]:
    """The ranked tables without those equal to a better one, at most k."""
    seen, out = set(), []
    for name in ranked:
        mark = (*lake.table(name).columns, *fingerprint(lake.table(name)).first())
        if mark not in seen:
            seen.add(mark)
            out.append(name)
        if len(out) == k:
            break
    return out
