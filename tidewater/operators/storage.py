"""Storage cost model: sizes of tables, what unions and joins save, and the cheapest way to keep a derived table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import alike_names
from tidewater.sources.lake import family

#: Fixed values of the model: bytes of integers and floats, weight of storage, time units of a scanned row or cell.
INT_BYTES, FLOAT_BYTES, STORAGE_WEIGHT, SCAN = 4, 8, 0.9, 0.01
STRATEGIES = ("separate", "lineage", "join_row", "union_row")


def _size(value: Column, kind: str) -> Column:
    if family(kind) == "string":
        return F.length(value)
    return F.lit(FLOAT_BYTES if kind in ("double", "float") else INT_BYTES)


def table_size(df: DataFrame) -> DataFrame:
    """Modelled bytes of the non-null cells."""
    parts = [F.coalesce(F.sum(F.when(F.col(f"`{c}`").isNotNull(), _size(F.col(f"`{c}`"), k))), F.lit(0)) for c, k in df.dtypes]
    return df.agg(sum(parts, F.lit(0)).cast("long").alias("size"))


def table_size_unique(df: DataFrame) -> DataFrame:
    """Modelled bytes of the distinct values of each column."""
    out = None
    for c, k in df.dtypes:
        one = df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().agg(F.coalesce(F.sum(_size(F.col("v"), k)), F.lit(0)).cast("long").alias("size"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.sum("size").cast("long").alias("size"))


def row_text(columns: list[str]) -> Column:
    """Cells joined by commas, nulls as nan."""
    return F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in columns))


def join_score(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Rows of the join over rows of each table: (n_join, score_a, score_b), from counts of values."""
    x = a.where(F.col(key_a).isNotNull()).groupBy(F.col(key_a).alias("k")).agg(F.count(F.lit(1)).alias("x"))
    y = b.where(F.col(key_b).isNotNull()).groupBy(F.col(key_b).alias("k")).agg(F.count(F.lit(1)).alias("y"))
    joined = x.join(y, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("n_join"))
    sizes = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    return joined.crossJoin(sizes).select("n_join", F.try_divide("n_join", "na").alias("score_a"), F.try_divide("n_join", "nb").alias("score_b"))


def union_benefit(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(benefit, direction): size of the smaller table if its rows stand in the larger one, else -1; 1 if a is smaller."""
    na, nb = a.agg(F.count(F.lit(1)).alias("na")), b.agg(F.count(F.lit(1)).alias("nb"))
    x, y = a.select(row_text(columns).alias("r")), b.select(row_text(columns).alias("r"))
    missing = lambda p, q, n: p.join(q, "r", "left_anti").agg(F.count(F.lit(1)).alias(n))
    sizes = table_size(a.select(*columns)).withColumnRenamed("size", "sa").crossJoin(table_size(b.select(*columns)).withColumnRenamed("size", "sb"))
    all_ = na.crossJoin(nb).crossJoin(missing(x, y, "ma")).crossJoin(missing(y, x, "mb")).crossJoin(sizes)
    smaller = F.col("na") <= F.col("nb")
    return all_.select(
        F.when(smaller & (F.col("ma") == 0), F.col("sa")).when(~smaller & (F.col("mb") == 0), F.col("sb")).otherwise(F.lit(-1)).cast("long").alias("benefit"), F.when(smaller, 1).otherwise(-1).alias("direction"),
    )


def strategy_costs(stats: DataFrame) -> DataFrame:
    """(strategy, cost) from one row: size, n_rows, run_time, code_length, union_saved, union_rows, join_saved, join_rows."""
    w, t = STORAGE_WEIGHT, 1 - STORAGE_WEIGHT
    costs = {
        "separate": w * F.col("size") + t * SCAN * F.col("n_rows"), "lineage": t * F.col("run_time") + w * F.col("code_length"),
        "join_row": w * (F.col("size") - F.col("join_saved")) + t * SCAN * F.col("join_rows"), "union_row": w * (F.col("size") - F.col("union_saved")) + t * SCAN * F.col("union_rows"),
    }
    return stats.select(F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), costs[s].alias("cost")) for s in STRATEGIES))).alias("x")).select("x.*")


def choose_strategy(stats: DataFrame) -> DataFrame:
    return strategy_costs(stats).agg(F.min(F.struct("cost", "strategy")).alias("m")).select("m.strategy", "m.cost")


def _overlap(a: DataFrame, b: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(a, b, overlap) of column pairs: shared distinct values over the smaller number of them; nulls count as 0."""
    out = None
    text = lambda d, c: d.select(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0")).alias("v")).distinct()
    for x, y in names:
        marked = text(a, x).withColumn("a", F.lit(1)).join(text(b, y).withColumn("b", F.lit(1)), "v", "full")
        one = marked.agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"))
        one = one.select(F.lit(x).alias("a"), F.lit(y).alias("b"), F.coalesce(F.try_divide("both", F.least("na", "nb")), F.lit(0.0)).alias("overlap"))
        out = one if out is None else out.unionByName(one)
    return out


def join_pair(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> dict[str, str]:
    """The columns that two tables may join on: names alike, most values shared, chosen greedily by overlap (ties by place).

    All values count, not a sample of them.
    """
    names = [(x, y) for x, y, _ in alike_names(a.columns, b.columns)]
    if not names:
        return {}
    place = {p: k for k, p in enumerate(names)}
    found = sorted((-r["overlap"], place[r["a"], r["b"]], r["a"], r["b"]) for r in _overlap(a, b, names).collect() if r["overlap"] >= threshold)
    chosen: dict[str, str] = {}
    for _, _, x, y in found:
        if x not in chosen and y not in chosen.values():
            chosen[x] = y
    return chosen


def join_benefit(a: DataFrame, b: DataFrame, pair: dict[str, str]) -> DataFrame:
    """(benefit): least storage that keeping the join of a and b instead of both saves; 0 without a pair or with an empty table.

    With the rows' join columns as text, sel is the share of a's rows (over each table's rows) that stand in b, and score
    the mean number of matches of a row: sizeA selA + sizeB selB - sizeA selA scoreB - sizeB selB scoreA + selB scoreA
    (text length of b's join columns).
    """
    if not pair:
        return a.sparkSession.createDataFrame([(0.0,)], "benefit double")
    x, y = a.select(row_text([*pair]).alias("r")), b.select(row_text([*pair.values()]).alias("r"))
    counts = x.groupBy("r").agg(F.count(F.lit(1)).alias("ca")).join(y.groupBy("r").agg(F.count(F.lit(1)).alias("cb")), "r")
    both = counts.agg(F.coalesce(F.sum("ca"), F.lit(0)).alias("n_in"), F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("n_join"))
    sizes = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(y.agg(F.count(F.lit(1)).alias("nb"), F.coalesce(F.sum(F.length("r")), F.lit(0)).alias("text")))
    sizes = sizes.crossJoin(table_size(a).withColumnRenamed("size", "sa")).crossJoin(table_size(b).withColumnRenamed("size", "sb")).crossJoin(both)
    sel_a, sel_b, score_a, score_b = (F.try_divide(n, d) for n, d in (("n_in", "na"), ("n_in", "nb"), ("n_join", "na"), ("n_join", "nb")))
    size_a, size_b = F.col("sa") * sel_a, F.col("sb") * sel_b
    return sizes.select(F.coalesce(size_a + size_b - size_a * score_b - size_b * score_a + sel_b * score_a * F.col("text"), F.lit(0.0)).cast("double").alias("benefit"))


def cell_count(df: DataFrame) -> DataFrame:
    """(cells): non-null cells."""
    return df.agg(sum((F.count(f"`{c}`") for c in df.columns), F.lit(0)).alias("cells"))


def best_join_table(stored: dict[str, DataFrame], table: DataFrame, accept: bool = False) -> tuple[str, dict[str, str], float] | None:
    """(name, join pair, benefit) of the stored table that saves most when joined with ``table``; ties go by name.

    ``accept``: only if there is a pair and it saves at least the smallest of 100 and either table's number of cells.
    """
    pairs = {n: join_pair(df, table) for n, df in sorted(stored.items())}
    out = None
    for n, pair in pairs.items():
        one = join_benefit(stored[n], table, pair).select(F.lit(n).alias("name"), "benefit")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    best = out.orderBy(F.desc("benefit"), "name").first()
    if accept and (not pairs[best["name"]] or best["benefit"] < min(100, cell_count(table).first()["cells"], cell_count(stored[best["name"]]).first()["cells"])):
        return None
    return best["name"], pairs[best["name"]], best["benefit"]


def best_union_table(stored: dict[str, DataFrame], table: DataFrame) -> tuple[str, int] | None:
    """(name, benefit) of the stored table with equal columns that saves most when united with ``table``, ties by name; the
    benefit is negative where the stored table is the larger one."""
    out = None
    for n, df in sorted(stored.items()):
        if [*df.columns] == [*table.columns]:
            one = union_benefit(df, table, df.columns).select(F.lit(n).alias("name"), "benefit", "direction")
            out = one if out is None else out.unionByName(one)
    best = None if out is None else out.orderBy(F.desc("benefit"), "name").first()
    return None if best is None or best["benefit"] < 0 else (best["name"], best["benefit"] * best["direction"])


def join_column_cost(df: DataFrame) -> DataFrame:
    """(cost) of keeping a table as columns of references: 4 bytes a cell and each distinct value once, and the time to read its cells."""
    both = cell_count(df).crossJoin(table_size_unique(df))
    return both.select(((1 - STORAGE_WEIGHT) * SCAN * F.col("cells") + INT_BYTES * F.col("cells") + F.col("size")).alias("cost"))


def strategy_statistics(df: DataFrame, stored: dict[str, DataFrame], run_time: float, code: str) -> DataFrame:
    """The row that strategy_costs takes, measured from a table, the stored tables, and the code that makes it."""
    join, union = best_join_table(stored, df), best_union_table(stored, df)
    size = table_size(df).crossJoin(df.agg(F.count(F.lit(1)).alias("n_rows")))
    saved = (F.lit(0.0 if join is None else join[2]) - INT_BYTES * F.col("n_rows")).cast("long")
    return size.select("size", "n_rows", F.lit(run_time).alias("run_time"), F.lit(len(code)).cast("long").alias("code_length"), F.lit(0 if union is None else abs(union[1])).cast("long").alias("union_saved"), F.col("n_rows").alias("union_rows"), saved.alias("join_saved"), F.col("n_rows").alias("join_rows"))
