"""Schema matching: greedy one-to-one maps over scored column pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.similarity import similar_pairs

THRESHOLD = 0.5


def greedy(pairs: DataFrame, groups: list[str], a: str, b: str, score: str, order: tuple[str, str] | None = None, threshold: float | None = None, ascending: bool = False) -> DataFrame:
    """In each group takes pairs by score (ties by ``order``), when neither side is taken yet: groups, a, b, score.

    A group holds the column pairs of two tables, so it is as large as their schemas and independent of the rows.
    """
    if threshold is not None:
        pairs = pairs.where(F.col(score) >= threshold)
    first, second = order or (a, b)
    entry = F.struct((F.col(score) if ascending else -F.col(score)).alias("o"), F.col(first).alias("p"), F.col(second).alias("q"), F.col(a).alias("x"), F.col(b).alias("y"), F.col(score).alias("s"))
    sets = pairs.groupBy(*groups).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kind = pairs.select(entry.alias("e")).schema["e"].dataType.simpleString()
    taken = lambda acc, e: F.exists(acc, lambda t: (t["x"] == e["x"]) | (t["y"] == e["y"]))
    chosen = F.aggregate("all", F.array().cast(f"array<{kind}>"), lambda acc, e: F.when(taken(acc, e), acc).otherwise(F.concat(acc, F.array(e))))
    return sets.select(*groups, F.explode(chosen).alias("m")).select(*groups, F.col("m.x").alias(a), F.col("m.y").alias(b), F.col("m.s").alias(score))


def _size(domains: DataFrame) -> list[str]:
    """The column that classes of a lake have besides those of domains."""
    return [c for c in domains.columns if c == "size"]


def match_naive(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Maps the columns of every pair of tables of two domain frames by Jaccard."""
    scored = similar_pairs(a, b)
    return greedy(scored, ["table_a", "table_b"], "col_a", "col_b", "jaccard", ("pos_a", "pos_b"), threshold)


def match_incremental(a: DataFrame, b: DataFrame, known: DataFrame, unmatched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Keeps the pairs of ``known`` (table_a, col_a, table_b, col_b), skips those of ``unmatched``, and maps the rest."""
    on = ["table_a", "col_a", "table_b", "col_b"]
    scored = similar_pairs(a, b).join(unmatched, on, "left_anti")
    for side in ("a", "b"):
        scored = scored.join(known.select("table_a", "table_b", f"col_{side}"), ["table_a", "table_b", f"col_{side}"], "left_anti")
    fresh = greedy(scored, ["table_a", "table_b"], "col_a", "col_b", "jaccard", ("pos_a", "pos_b"), threshold)
    return known.select(*on).withColumn("jaccard", F.lit(None).cast("double")).unionByName(fresh.select(*on, "jaccard"))


def matching_groups(a: DataFrame, b: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups (table_b, grp) whose best column similarity reaches the threshold."""
    return similar_pairs(a, b).join(groups, "table_b").groupBy("table_a", "grp").agg(F.max("jaccard").alias("best")).where(F.col("best") >= threshold)


def match_groups(a: DataFrame, b: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Maps columns to the pooled values of the columns of a group of tables, by column name within the group."""
    pooled = b.join(groups.withColumnRenamed("table_b", "table_name"), "table_name").select(F.col("grp").alias("table_name"), "column_name", "dtype", "value", *_size(b)).distinct()
    pooled = pooled.join(pooled.groupBy("table_name", "column_name").agg(F.lit(0).alias("pos")), ["table_name", "column_name"])
    scored = similar_pairs(a, pooled.select("table_name", "column_name", "pos", "dtype", "value", *_size(b)))
    return greedy(scored, ["table_a", "table_b"], "col_a", "col_b", "jaccard", ("pos_a", "col_b"), threshold)


def match_names(columns_a: DataFrame, columns_b: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Columns of the same name and type in two catalogs, but for those already mapped."""
    pick = lambda d, s: d.select(F.col("table_name").alias(f"table_{s}"), "column_name", "dtype")
    out = pick(columns_a, "a").join(pick(columns_b, "b"), ["column_name", "dtype"]).where("table_a != table_b").select("table_a", F.col("column_name").alias("col_a"), "table_b", F.col("column_name").alias("col_b"))
    return out if mapped is None else out.join(mapped, ["table_a", "col_a", "table_b"], "left_anti")


def match_workflow(partial: DataFrame, by_name: DataFrame, groups: DataFrame) -> DataFrame:
    """A partial map, completed by equal names between tables of one workflow group (table_name, grp)."""
    same = by_name.join(groups.select(F.col("table_name").alias("table_a"), F.col("grp").alias("g")), "table_a").join(groups.select(F.col("table_name").alias("table_b"), F.col("grp").alias("h")), "table_b").where("g = h").drop("g", "h")
    on = ["table_a", "col_a", "table_b", "col_b"]
    return partial.select(*on).unionByName(same.join(partial, ["table_a", "col_a", "table_b"], "left_anti").select(*on))


def match_full(a: DataFrame, b: DataFrame, mapped: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Completes a map with floating-point columns only."""
    scored = similar_pairs(a.where("dtype = 'double'"), b.where("dtype = 'double'")).where(F.col("jaccard") > threshold)
    for side in ("a", "b"):
        scored = scored.join(mapped.select("table_a", "table_b", f"col_{side}"), ["table_a", "table_b", f"col_{side}"], "left_anti")
    fresh = greedy(scored, ["table_a", "table_b"], "col_a", "col_b", "jaccard", ("pos_a", "pos_b"))
    on = ["table_a", "col_a", "table_b", "col_b"]
    return mapped.select(*on).unionByName(fresh.select(*on))


def remember_match(mapped: DataFrame, scored: DataFrame, known: DataFrame, unmatched: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The memos of match_incremental after a step: pairs that match and pairs that don't, each once."""
    on = ["table_a", "col_a", "table_b", "col_b"]
    return known.select(*on).unionByName(mapped.select(*on)).distinct(), unmatched.select(*on).unionByName(scored.where(F.col("jaccard") < threshold).select(*on)).distinct()


def _pooled(b: DataFrame, groups: DataFrame) -> DataFrame:
    """Domains of the columns of a group of tables, pooled by name and type; the group stands for the table."""
    pooled = b.join(groups.withColumnRenamed("table_b", "table_name"), "table_name").select(F.col("grp").alias("table_name"), "column_name", "dtype", "value", *_size(b)).distinct()
    return pooled.withColumn("pos", F.lit(0)).select("table_name", "column_name", "pos", "dtype", "value", *_size(b))


def match_groups_join(a: DataFrame, b: DataFrame, groups: DataFrame, valid: list[str], sampled: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """For joinable search: the map of a's columns to each group's, and the pairs that did not match.

    The ``valid`` columns of a meet the pooled values of the groups; all columns of a then meet the groups' smaller value
    sets ``sampled`` (domains by group), but for pairs that failed before. One greedy choice is made over both.
    """
    on = ["table_a", "col_a", "table_b", "col_b"]
    first = _all_pairs(a.where(F.col("column_name").isin(*valid)), _pooled(b, groups))
    second = _all_pairs(a, sampled).join(first.where(F.col("jaccard") < threshold).select(*on), on, "left_anti")
    both = first.unionByName(second).groupBy(*on, "pos_a").agg(F.max("jaccard").alias("jaccard"), F.min("jaccard").alias("least"))
    mapped = greedy(both, ["table_a", "table_b"], "col_a", "col_b", "jaccard", ("pos_a", "col_b"), threshold)
    return mapped, both.where(F.col("least") < threshold).select(*on)


def _all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of all column pairs of equal type, also of those without a common value."""
    names = lambda d, s: d.select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), *([F.col("pos").alias("pos_a")] if s == "a" else []), "dtype").distinct()
    on = ["table_a", "col_a", "table_b", "col_b"]
    pairs = names(a, "a").join(names(b, "b"), "dtype").where(~F.col("col_a").contains("index") & ~F.col("col_b").contains("index"))
    return pairs.join(similar_pairs(a, b).select(*on, "jaccard"), on, "left").select(*on, "pos_a", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def match_group_schema(a: DataFrame, b: DataFrame, elements_a: DataFrame, elements_b: DataFrame) -> DataFrame:
    """Maps columns of equal type that stand for the same element of a group: table_a, col_a, table_b, col_b, jaccard.

    ``elements_a``, ``elements_b``: (table_name, column_name, element); ``a``, ``b``: domains. The similarity of the
    mapped columns is 0 where they share nothing; its largest is the score of the group.
    """
    named = lambda d, s: d.select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), "dtype").distinct()
    of = lambda e, s: e.select(F.col("table_name").alias(f"table_{s}"), F.col("column_name").alias(f"col_{s}"), "element")
    x, y = named(a, "a").join(of(elements_a, "a"), ["table_a", "col_a"]), named(b, "b").join(of(elements_b, "b"), ["table_b", "col_b"])
    on = ["table_a", "col_a", "table_b", "col_b"]
    return x.join(y, ["element", "dtype"]).select(*on).join(similar_pairs(a, b).select(*on, "jaccard"), on, "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))


def partial_maps(hits: DataFrame) -> DataFrame:
    """(table_a, table_b, mapping): hits (table_a, col_a, table_b, col_b, score) of single columns as one map for each table."""
    chosen = greedy(hits, ["table_a", "table_b"], "col_a", "col_b", "score")
    return chosen.groupBy("table_a", "table_b").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_a", "col_b")))).alias("mapping"))
