"""Two-sample Kolmogorov-Smirnov similarity of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.plans.tables import settle

#: Ranges of values that are counted before any two columns are compared. More make smaller tasks.
RANGES, STEP = 64, 8
KEY = ["table_a", "col_a", "table_b", "col_b"]


def value_counts(cells: DataFrame) -> DataFrame:
    """(table_name, column_name, dtype, x, n) of numeric cells: repeated values are counted before anything is paired."""
    return cells.where("dtype in ('long', 'double') and value is not null").groupBy("table_name", "column_name", "dtype", F.col("value").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))


def _ranged(d: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """The rows with ``range``, the number of cuts of its type that are not above x: every STEP-th cut is looked at first, then
    those between, so that the code for a row stays short."""
    out = None
    for kind, own in cuts.items():
        at = [F.lit(x) for x in (*own, *[float("nan")] * (RANGES - len(own)))]  # NaN is above all numbers
        first = sum(((F.col("x") >= at[k]).cast("int") for k in range(STEP - 1, RANGES, STEP)), F.lit(0)) * STEP
        rest = sum((F.coalesce(F.col("x") >= F.get(F.array(*at), F.col("first") + k), F.lit(False)).cast("int") for k in range(STEP - 1)), F.col("first"))
        one = d.where(F.col("dtype") == kind).withColumn("first", F.coalesce(first, F.lit(0))).withColumn("range", F.coalesce(rest, F.lit(0))).drop("first")
        out = one if out is None else out.unionByName(one)
    return d.where("false").withColumn("range", F.lit(0)) if out is None else out


def _counts_at(pairs: DataFrame, counted: DataFrame, other: DataFrame) -> DataFrame:
    """For each pair and range: how many values of either column are below it and in it (below_a, in_a, below_b, in_b), all_a
    and all_b. Both frames have a row for each column and range, so this is as large as the schemas."""
    name = lambda d, s: d.select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), "range", F.col("n").alias(f"in_{s}"))
    each = F.explode(F.sequence(F.lit(0), F.lit(RANGES))).alias("range")
    wide = pairs.select("*", each).join(name(counted, "a"), ["table_a", "col_a", "range"], "left").join(name(other, "b"), ["table_b", "col_b", "range"], "left").fillna(0, ["in_a", "in_b"])
    run, whole = Window.partitionBy(*KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*KEY)
    for s in ("a", "b"):
        wide = wide.withColumn(f"below_{s}", F.coalesce(F.sum(f"in_{s}").over(run), F.lit(0))).withColumn(f"all_{s}", F.sum(f"in_{s}").over(whole))
    return wide


def _bounded(a: DataFrame, b: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """(pairs by range with ``least``, the distance at the ends of ranges, and ``most``, what it can be within this range;
    the cuts). The values are read twice, and rows are shuffled by column and range only."""
    # cuts deal the rows of both sides in ranges of about equal number; results don't depend on where they are
    at = ", ".join(str(k / RANGES) for k in range(1, RANGES))
    quantiles = lambda kind: F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double(CASE WHEN dtype = '{kind}' THEN x END, 800), array({at}))")
    held = lambda kind: F.count_if(F.col("dtype") == kind) > 0
    both = a.select("dtype", "x").unionByName(b.select("dtype", "x"))
    found = both.agg(*(F.when(held(kind), quantiles(kind)).alias(kind) for kind in ("long", "double"))).first()
    cuts = {kind: sorted(set(found[kind])) for kind in ("long", "double") if found[kind]}
    count = lambda d: settle(_ranged(d, cuts).groupBy("table_name", "column_name", "dtype", "range").agg(F.sum("n").alias("n")))
    x, y = count(a), count(b)
    names = lambda d, s: d.select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), "dtype").distinct()
    pairs = names(x, "a").join(names(y, "b"), "dtype").where("table_a != table_b or col_a != col_b")
    share = lambda s, ended: (F.col(f"below_{s}") + F.col(f"in_{s}") if ended else F.col(f"below_{s}")) / F.col(f"all_{s}")
    most = F.greatest(share("a", True) - share("b", False), share("b", True) - share("a", False))
    wide = _counts_at(pairs, x, y).withColumn("most", most).withColumn("end", F.abs(share("a", True) - share("b", True)))
    return settle(wide.withColumn("least", F.max("end").over(Window.partitionBy(*KEY)))), cuts


def _within(a: DataFrame, b: DataFrame, wanted: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(pair, d): the largest distance at a value within the wanted ranges of pairs. A task orders the values of one pair in one
    range; the counts below it are known."""
    wanted = wanted.where("in_a + in_b > 0")
    wanted = settle(wanted.join(settle(wanted.select(*KEY).distinct().withColumn("pair", F.monotonically_increasing_id())), KEY))
    side = lambda d, s, na, nb: (
        _ranged(d, cuts).select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), "range", "x", "n")
        .join(F.broadcast(wanted.select(f"table_{s}", f"col_{s}", "range", "pair")), [f"table_{s}", f"col_{s}", "range"]).select("pair", "range", "x", na.alias("na"), nb.alias("nb"))
    )
    none = F.lit(0).cast("long")
    both = side(a, "a", F.col("n"), none).unionByName(side(b, "b", none, F.col("n"))).groupBy("pair", "range", "x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    run = Window.partitionBy("pair", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("pair", "range", F.sum("na").over(run).alias("na"), F.sum("nb").over(run).alias("nb")).join(F.broadcast(wanted), ["pair", "range"])
    apart = F.abs((F.col("below_a") + F.col("na")) / F.col("all_a") - (F.col("below_b") + F.col("nb")) / F.col("all_b"))
    return seen.groupBy(*KEY).agg(F.max(apart).alias("d"))


def ks_pairs(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """d and score = 1 - d of every pair of columns of equal type whose score reaches the threshold: (table_a, col_a, table_b,
    col_b, d, score). The sides have (table_name, column_name, dtype, x, n), n rows of x, however often x stands.

    Counts by range of values give the distance at the ends of ranges and what it can be within; only ranges where it can be
    larger are ordered value by value, each pair and range by itself.
    """
    ranges, cuts = _bounded(a, b)
    ranges = ranges.where(1 - F.col("least") >= threshold)
    ends = ranges.select(*KEY, F.col("least").alias("d")).distinct()
    both = ends.unionByName(_within(a, b, ranges.where("most > least"), cuts)).groupBy(*KEY).agg(F.max("d").alias("d"))
    return both.withColumn("score", 1 - F.col("d")).where(F.col("score") >= threshold)


def ks_query(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    return ks_pairs(a, b, threshold)


def ks_hits(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(table_a, col_a, table_b, col_b) of the pairs that ks_query finds. Values are ordered only where the bounds of a range
    leave open whether the score reaches the threshold."""
    ranges, cuts = _bounded(a, b)
    ranges = ranges.where(1 - F.col("least") >= threshold)
    wide = _within(a, b, ranges.where(1 - F.col("most") < threshold), cuts).where(1 - F.col("d") < threshold)
    return ranges.select(*KEY).distinct().join(wide, KEY, "left_anti")
