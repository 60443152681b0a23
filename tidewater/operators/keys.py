"""Keys that two tables share, what depends on them, and how well tables relate through them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.similarity import column_jaccard, column_similarity, values_once


def key_candidates(a: DataFrame, mapping: dict[str, str]) -> list[str]:
    """The mapped columns that may be keys: all but floating-point ones."""
    return [c for c in mapping if a.schema[c].dataType.typeName() not in ("double", "float")]


def _pairs(a: DataFrame, b: DataFrame, mapping: dict[str, str], key: str, one_a: bool, one_b: bool) -> DataFrame:
    """Rows of a and b with equal keys: k, a_<column>, b_<column>. ``one_a``, ``one_b``: only values that stand once there."""
    other = [c for c in mapping if c != key]
    x = a.select(F.col(f"`{key}`").alias("k"), *(F.col(f"`{c}`").alias(f"a_{c}") for c in other)).where("k is not null")
    y = b.select(F.col(f"`{mapping[key]}`").alias("k"), *(F.col(f"`{mapping[c]}`").alias(f"b_{c}") for c in other)).where("k is not null")
    # the sides are as large as the tables: none is gathered on the driver
    if one_a:
        x = x.join(values_once(a, key).hint("merge"), "k")
    if one_b:
        y = y.join(values_once(b, mapping[key]).hint("merge"), "k")
    return x.join(y.hint("merge"), "k")


def _ratios(a: DataFrame, b: DataFrame, mapping: dict[str, str], key: str) -> DataFrame:
    """One row: distinct share of the key in each table, the number of its values in both together, those that stand once in
    each, those that stand once in one, and whether all do. The rows of both tables are counted by value in one grouping."""
    side = lambda d, c, x, y: d.select(F.col(f"`{c}`").alias("v"), F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("b"))
    counts = side(a, key, 1, 0).unionByName(side(b, mapping[key], 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    held = F.col("v").isNotNull()
    share = lambda s: F.coalesce(F.try_divide(F.count_if(held & (F.col(s) > 0)), F.sum(s)), F.lit(0.0)).alias(f"ratio_{s}")
    once = lambda s: ~F.coalesce(F.bool_or(held & (F.col(s) > 1)), F.lit(False))
    return counts.agg(share("a"), share("b"), F.count_if(held).alias("n_union"), F.count_if(held & (F.col("a") == 1) & (F.col("b") == 1)).alias("n_pairs"), once("a").alias("once_a"), once("b").alias("once_b"), F.coalesce(F.sum("a"), F.lit(0)).alias("rows_a"))


def key_statistics(a: DataFrame, b: DataFrame, mapping: dict[str, str], candidates: list[str] | None = None, key_threshold: float = 0.01) -> list:
    """The candidates that hold as keys: one row each of (key, ratio, n_pairs, once_a, once_b, rows_a).

    They hold by their own values, whatever the other columns are, so only key columns are read and shuffled here. One row a
    candidate comes to the driver, as many as a table has columns.
    """
    out = None
    for key in key_candidates(a, mapping) if candidates is None else candidates:
        row = _ratios(a, b, mapping, key).select(F.lit(key).alias("key"), F.try_divide("n_pairs", "n_union").alias("ratio"), F.least("ratio_a", "ratio_b").alias("least"), "n_pairs", "once_a", "once_b", "rows_a")
        out = row if out is None else out.unionByName(row)
    return [] if out is None else out.where((F.col("ratio") >= key_threshold) & (F.col("least") >= key_threshold)).collect()


def _depending(names: list[str], share_of: str, threshold: float) -> Column:
    """The columns whose equal cells, e_<column>, exceed the threshold's share, as a sorted list."""
    return F.array_sort(F.filter(F.array(*(F.when(F.col(f"e_{c}") > threshold * F.col(share_of), F.lit(c)) for c in names)).cast("array<string>"), lambda c: c.isNotNull()))


def detect_key(a: DataFrame, b: DataFrame, mapping: dict[str, str], candidates: list[str] | None = None, key_threshold: float = 0.01, dependent_threshold: float = 0.01, held: list | None = None, fills: bool = False) -> DataFrame:
    """(key_a, key_b, n_pairs, ratio, dependents, equal_cells) of the keys that hold, best first.

    Rows pair where the key's value stands exactly once in each table. A key holds if its values are distinct enough in
    both tables and its pairs are a large enough share of all values; a mapped column depends on it if it is equal on
    more than the threshold's share of pairs; the key with most equal cells is best. Whole rows are paired only by keys that
    hold, each a branch of one plan.

    ``held``: the rows of key_statistics, if they are known. ``fills`` adds nan_delta: the cells null or NaN in a that b fills
    over these pairs, as a share of all cells of a.
    """
    out = None
    gone = lambda d, c, n: F.col(n).isNull() | F.isnan(n) if d.schema[c].dataType.typeName() in ("double", "float") else F.col(n).isNull()
    for own in key_statistics(a, b, mapping, candidates, key_threshold) if held is None else held:
        key = own["key"]
        other = [c for c in mapping if c != key]
        same = [F.coalesce(F.sum(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("int")), F.lit(0)).alias(f"e_{c}") for c in other]
        filled = sum((F.when(gone(a, c, f"a_{c}") & ~gone(b, mapping[c], f"b_{c}"), 1).otherwise(0) for c in other), F.lit(0))
        found = _pairs(a, b, mapping, key, not own["once_a"], not own["once_b"]).agg(F.lit(own["n_pairs"]).cast("long").alias("n_pairs"), *same, F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
        row = found.select(
            F.lit(key).alias("key_a"), F.lit(mapping[key]).alias("key_b"), "n_pairs", F.lit(own["ratio"]).alias("ratio"), _depending(other, "n_pairs", dependent_threshold).alias("dependents"),
            sum((F.col(f"e_{c}") for c in other), F.lit(0)).cast("long").alias("equal_cells"), (F.col("filled") / F.lit(max(own["rows_a"] * len(a.columns), 1))).alias("nan_delta"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        out = a.sparkSession.createDataFrame([], "key_a string, key_b string, n_pairs long, ratio double, dependents array<string>, equal_cells long, nan_delta double")
    return (out if fills else out.drop("nan_delta")).orderBy(F.desc("equal_cells"), "key_a")


def detect_foreign_key(a: DataFrame, b: DataFrame, mapping: dict[str, str], candidates: list[str] | None = None, key_threshold: float = 0.1, dependent_threshold: float = 0.05, prune: float = 0.5) -> DataFrame:
    """(key_a, key_b, unique_side, n_pairs, ratio, dependents, equal_cells) of keys that are unique on one side, best first.

    The side with more pairs is taken as the unique one (a if equal). A column is equal at a key if it is on any of the
    key's rows of the other side. Keys that repeat much in both tables (distinct share below ``prune``) are left out.
    """
    out = None
    for key in key_candidates(a, mapping) if candidates is None else candidates:
        other = [c for c in mapping if c != key]
        ratios = _ratios(a, b, mapping, key)
        for side in ("a", "b"):
            pairs = _pairs(a, b, mapping, key, side == "a", side == "b")
            any_ = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("int")).alias(f"e_{c}") for c in other))
            total = any_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_keys"), *(F.coalesce(F.sum(f"e_{c}"), F.lit(0)).alias(f"e_{c}") for c in other))
            row = total.crossJoin(ratios.select("n_union", "ratio_a", "ratio_b")).select(
                F.lit(key).alias("key_a"), F.lit(mapping[key]).alias("key_b"), F.lit(side).alias("unique_side"), "n_pairs", F.try_divide("n_keys", "n_union").alias("ratio"),
                _depending(other, "n_keys", dependent_threshold).alias("dependents"), sum((F.col(f"e_{c}") for c in other), F.lit(0)).cast("long").alias("equal_cells"), F.greatest("ratio_a", "ratio_b").alias("most"),
            )
            out = row if out is None else out.unionByName(row)
    if out is None:
        return a.sparkSession.createDataFrame([], "key_a string, key_b string, unique_side string, n_pairs long, ratio double, dependents array<string>, equal_cells long")
    kept = out.where((F.col("ratio") >= key_threshold) & (F.col("most") >= prune)).drop("most")
    row = F.struct("n_pairs", F.when(F.col("unique_side") == "a", 1).otherwise(0).alias("first"), F.struct(*kept.columns).alias("row"))
    return kept.groupBy("key_a").agg(F.max(row).alias("m")).select("m.row.*").orderBy(F.desc("equal_cells"), "key_a")


def key_rows(a: DataFrame, b: DataFrame, key_a: str, key_b: str, id_a: str, id_b: str) -> DataFrame:
    """(row_a, row_b): ids of the rows that a key pairs, its value standing once in each table."""
    x = a.select(F.col(key_a).alias("k"), F.col(id_a).alias("row_a")).join(values_once(a, key_a), "k")
    y = b.select(F.col(key_b).alias("k"), F.col(id_b).alias("row_b")).join(values_once(b, key_b), "k")
    return x.join(y, "k").select("row_a", "row_b")


def full_dependency(a: DataFrame, b: DataFrame, mapping: dict[str, str], key: str, foreign: str | None = None, threshold: float | None = None) -> DataFrame:
    """(col_a, col_b, equal, share, dependent): how each column of a full mapping depends on a known key.

    ``foreign``: None for a key that is unique in both tables, else the side, a or b, that it is unique in.
    """
    limit = (0.01 if foreign is None else 0.05) if threshold is None else threshold
    other = [c for c in mapping if c != key]
    pairs = _pairs(a, b, mapping, key, foreign != "b", foreign != "a")
    same = [F.max(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("int")).alias(f"e_{c}") for c in other]
    total = pairs.groupBy("k").agg(F.lit(1).alias("one"), *same).agg(F.count("one").alias("n"), *(F.coalesce(F.sum(f"e_{c}"), F.lit(0)).alias(f"e_{c}") for c in other))
    rows = F.array(*(F.struct(F.lit(c).alias("col_a"), F.lit(mapping[c]).alias("col_b"), F.col(f"e_{c}").alias("equal")) for c in other))
    each = total.select("n", F.explode(rows).alias("x")).select("n", "x.*")
    return each.select("col_a", "col_b", "equal", F.coalesce(F.try_divide("equal", "n"), F.lit(0.0)).alias("share"), (F.col("equal") > limit * F.col("n")).alias("dependent"))


def choose_key(a: DataFrame, b: DataFrame, mapping: dict[str, str], supplied: list[str] | None = None) -> list[tuple[str, str]]:
    """The keys to compare two tables by: the supplied ones that are mapped, else the best detected one, else none."""
    if supplied:
        return [(k, mapping[k]) for k in supplied if k in mapping]
    found = detect_key(a, b, mapping).limit(1).collect()
    return [(r["key_a"], r["key_b"]) for r in found]


def distinct_ratio(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.try_divide(F.countDistinct(key), F.count(F.lit(1))).alias("ratio"), F.count(F.lit(1)).alias("n"))


def common_key_score(a: DataFrame, b: DataFrame, mapping: dict[str, str], key: str, prune: float) -> DataFrame:
    """Distinct mapped tuples of both tables over all their rows; 0 if the key is too repetitive in one."""
    x = a.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(mapping)))
    y = b.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(mapping.values())))
    tuples = x.unionByName(y).distinct().agg(F.count(F.lit(1)).alias("tuples"))
    ratios = distinct_ratio(a, key).select(F.col("ratio").alias("ra"), F.col("n").alias("na")).crossJoin(distinct_ratio(b, mapping[key]).select(F.col("ratio").alias("rb"), F.col("n").alias("nb"))).crossJoin(tuples)
    return ratios.select(F.when(F.least("ra", "rb") <= prune, 0.0).otherwise(F.try_divide("tuples", F.col("na") + F.col("nb"))).alias("score"))


def join_key_score(a: DataFrame, b: DataFrame, mapping: dict[str, str], key: str, prune: float) -> DataFrame:
    """1 if the key is unique in one table, 0 if it is too repetitive, else the larger share of distinct tuples of a
    table with the matching rows of the other."""
    x = a.select(F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(mapping)))
    y = b.select(F.col(mapping[key]).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(mapping.values())))
    one = lambda p, q, n: p.unionByName(q.join(p.select("k"), "k", "left_semi")).distinct().agg(F.count(F.lit(1)).alias(n))
    ratios = distinct_ratio(a, key).select(F.col("ratio").alias("ra"), F.col("n").alias("na")).crossJoin(distinct_ratio(b, mapping[key]).select(F.col("ratio").alias("rb"), F.col("n").alias("nb")))
    both = ratios.crossJoin(one(x, y, "ta")).crossJoin(one(y, x, "tb"))
    share = F.try_divide(F.greatest("ta", "tb"), F.col("na") + F.col("nb"))
    return both.select(F.when((F.col("ra") == 1) | (F.col("rb") == 1), 1.0).when(F.least("ra", "rb") < prune, 0.0).otherwise(share).alias("score"))


def approximate_join_key(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Larger share of distinct values among the rows whose key stands in the other table; 0 without overlap."""
    x, y = a.select(F.col(key_a).alias("k")), b.select(F.col(key_b).alias("k"))
    one = lambda p, q, n: p.join(q, "k", "left_semi").agg(F.try_divide(F.countDistinct("k"), F.count(F.lit(1))).alias(n))
    return one(x, y, "p").crossJoin(one(y, x, "q")).select(F.coalesce(F.greatest("p", "q"), F.lit(0.0)).alias("score"))


@dataclass
class Determined:
    """Keys that were found to determine whole maps, so that later tables need not try other keys: column -> sets of mapped columns."""

    known: dict[str, list[frozenset[str]]] = field(default_factory=dict)

    def holds(self, key: str, mapping: dict[str, str]) -> bool:
        return any(own <= {*mapping.values()} for own in self.known.get(key, ()))

    def add(self, key: str, mapping: dict[str, str]) -> None:
        self.known.setdefault(key, []).append(frozenset(mapping.values()))


def best_common_key(a: DataFrame, b: DataFrame, mapping: dict[str, str], prune: float, memo: Determined | None = None, keep: float = 0.9) -> tuple[str, float] | None:
    """(column, score) of the mapped column with the best common_key_score, the first of equals; None without a map.

    A column that the memo knows to determine the map, or whose score is 1, ends the search; a score of ``keep`` is remembered.
    """
    memo, scored = memo or Determined(), []
    for key in mapping:
        scored.append((common_key_score(a, b, mapping, key, prune).first()["score"] or 0.0, key))
        if scored[-1][0] == 1 or memo.holds(key, mapping):
            break
    if not scored:
        return None
    score, key = max(scored, key=lambda x: x[0])
    if score >= keep:
        memo.add(key, mapping)
    return key, score


def best_join_key(a: DataFrame, b: DataFrame, mapping: dict[str, str], prune: float) -> tuple[str, float] | None:
    """(column, score) of the mapped column with the best join_key_score, the first of equals; all are scored in one plan."""
    out = None
    for place, key in enumerate(mapping):
        one = join_key_score(a, b, mapping, key, prune).select(F.lit(place).alias("place"), F.lit(key).alias("key"), F.coalesce("score", F.lit(0.0)).alias("score"))
        out = one if out is None else out.unionByName(one)
    found = None if out is None else out.orderBy(F.desc("score"), "place").first()
    return None if found is None else (found["key"], found["score"])


def table_relatedness(row_similarity: DataFrame, n_a: int, n_b: int, mapped: int, beta: float, key_factor: float = 1.0, joinable: bool = False, below: int | None = None) -> DataFrame:
    """beta x column similarity + (1 - beta) x row similarity (one row, column ``row_similarity``)."""
    if joinable:
        below = n_a + n_b - mapped if below is None else below
        columns = max(1 + (n_a - 1) * key_factor, 1 + (n_b - 1) * key_factor) / below if below > 0 else 0.0
    else:
        columns = column_similarity(n_a, n_b, mapped, key_factor)
    return row_similarity.select((F.lit(beta * columns) + (1 - beta) * F.col("row_similarity")).alias("score"))


def _related(a: DataFrame, b: DataFrame, mapping: dict[str, str], full: dict[str, str], chosen: tuple[str, float] | None, beta: float, joinable: bool, below: int | None) -> DataFrame:
    """(key, key_score, col_sim, row_sim, score) of two tables by the chosen key; all 0 without one."""
    if chosen is None:
        return a.sparkSession.createDataFrame([(None, 0.0, 0.0, 0.0, 0.0)], "key string, key_score double, col_sim double, row_sim double, score double")
    key, factor = chosen
    rows = column_jaccard(a, key, b, full[key]).select(F.col("jaccard").alias("row_similarity"))
    only = lambda beta: table_relatedness(rows, len(a.columns), len(b.columns), len(full), beta, factor, joinable, below)
    parts = rows.crossJoin(only(beta)).crossJoin(only(1.0).withColumnRenamed("score", "col_sim"))
    return parts.select(F.lit(key).alias("key"), F.lit(float(factor)).alias("key_score"), "col_sim", F.col("row_similarity").alias("row_sim"), "score")


def related_by_rows(a: DataFrame, b: DataFrame, mapping: dict[str, str], beta: float, prune: float, memo: Determined | None = None, full: dict[str, str] | None = None) -> DataFrame:
    """How alike two tables are as collections of the same things, by the best common key over ``mapping``.

    ``full``: a completed map that the column similarity counts instead, as for a map that is known in part at first.
    """
    return _related(a, b, mapping, full or mapping, best_common_key(a, b, mapping, prune, memo), beta, False, None)


def related_by_join(a: DataFrame, b: DataFrame, mapping: dict[str, str], beta: float, prune: float, full: dict[str, str] | None = None) -> DataFrame:
    """How well two tables join, by the best common key over ``mapping``; with a completed map ``full``, by the best join
    key, which the columns of both then share once."""
    if full is None:
        return _related(a, b, mapping, mapping, best_common_key(a, b, mapping, prune), beta, True, None)
    return _related(a, b, mapping, full, best_join_key(a, b, mapping, prune), beta, True, len(a.columns) + len(b.columns) - len(full) - 1)
